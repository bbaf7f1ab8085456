"""A schema as files: one per object, brought together by imports."""

from __future__ import annotations

import os
import re

from tarn.catalog import dependencies, full_name
from tarn.sqlfront.ast import Stmt
from tarn.sqlfront.ddl import write

# Folders by kind of statement, in the order in which they are imported.
FOLDERS = {"CREATE DATABASE": "", "CREATE NAMED COLLECTION": "collections", "CREATE TABLE": "tables", "CREATE DICTIONARY": "dictionaries", "CREATE VIEW": "views"}
GLOBALS = {"CREATE ROLE": "roles", "GRANT": "roles", "CREATE FUNCTION": "functions", "CREATE NAMED COLLECTION": "collections"}


def image(statements: list[Stmt]) -> dict[str, str]:
    """Relative paths and contents: ``main.sql``, a file per database that imports its objects, and one per object.

    Roles, functions and named collections have files of their own above the databases. Views come
    after those that they read.
    """
    files: dict[str, list[str]] = {}
    imports: dict[str, list[str]] = {}
    top: list[str] = []
    reads = dependencies(statements)

    def depth(name: str, seen: tuple[str, ...] = ()) -> int:
        return 0 if name in seen else 1 + max((depth(r, (*seen, name)) for r in reads.get(name, ()) if r in reads), default=0)

    order = list(FOLDERS)
    for s in sorted(statements, key=lambda s: (order.index(s.kind) if s.kind in order else -1, depth(full_name(s.name)) if s.kind == "CREATE VIEW" else 0)):
        if s.kind in GLOBALS:
            path = f"global/{GLOBALS[s.kind]}.sql"
            files.setdefault(path, []).append(write(s))
            if path not in top:
                top.append(path)
            continue
        if s.kind not in FOLDERS:
            continue
        database = s.name[0] if len(s.name) > 1 or s.kind == "CREATE DATABASE" else "default"
        schema = f"schemas/{database}/schema.sql"
        if schema not in imports:
            imports[schema] = []
            top.append(schema)
            files.setdefault(schema, [])
        if s.kind == "CREATE DATABASE":
            files[schema].insert(0, write(s))
        else:
            path = f"{FOLDERS[s.kind]}/{s.name[-1]}.sql"
            files[f"schemas/{database}/{path}"] = [write(s)]
            imports[schema].append(path)
    out = {}
    for path, texts in files.items():
        body = "".join(f"{t};\n\n" for t in texts)
        out[path] = (body + "".join(f"-- tarn:import {p}\n" for p in imports.get(path, ()))).rstrip("\n") + "\n"
    out["main.sql"] = "".join(f"-- tarn:import {p}\n" for p in top)
    return out


def write_image(root: str, statements: list[Stmt], replace_main: bool = True) -> list[str]:
    """Writes the image under a folder; files that exist stay as they are, but for main.sql. The paths written."""
    written = []
    for path, text in image(statements).items():
        at = os.path.join(root, path)
        if os.path.exists(at) and not (path == "main.sql" and replace_main):
            continue
        os.makedirs(os.path.dirname(at) or ".", exist_ok=True)
        with open(at, "w", encoding="utf-8") as f:
            f.write(text)
        written.append(path)
    return written


def cleaned(ddl: str) -> str:
    """DDL text as servers report it, in a form that parses: hidden secrets, numbers without decimals, lifetimes."""
    ddl = re.sub(r"\bPASSWORD\s+\[HIDDEN\]", "PASSWORD '[HIDDEN]'", ddl, flags=re.IGNORECASE)
    ddl = re.sub(r"(DEFAULT\s+-?\d+)\.(?=[\s,)]|$)", r"\1.0", ddl)
    return re.sub(r"LIFETIME\(\s*MIN\s+0\s+MAX\s+(\d+)\s*\)", r"LIFETIME(\1)", ddl, flags=re.IGNORECASE)
