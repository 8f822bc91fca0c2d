"""Predicates on paths, names and contents of files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions, names and folders that are not worth reading.
SKIP_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".bmp", ".tiff", ".avif", ".svg", ".pdf", ".zip",
    ".gz", ".tar", ".bz2", ".xz", ".7z", ".rar", ".mp3", ".mp4", ".avi", ".mov", ".wav", ".webm",
    ".flac", ".ogg", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".so", ".dll", ".dylib", ".exe", ".bin",
    ".o", ".a", ".class", ".jar", ".pyc", ".pyo", ".wasm", ".node", ".db", ".sqlite", ".sqlite3", ".lock",
    ".map", ".min.js", ".min.css", ".pack", ".idx",
]
SKIP_NAMES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "poetry.lock", "Pipfile.lock",
    "composer.lock", "Cargo.lock", "go.sum", "gemfile.lock", ".DS_Store",
]
SKIP_FOLDERS = [
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv", "env", ".env.d", "dist",
    "build", "out", "target", ".next", ".nuxt", ".cache", ".turbo", ".parcel-cache", "coverage", ".pytest_cache",
    ".mypy_cache", ".ruff_cache", ".gradle", ".idea", ".vscode",
]
#: Fixed value: names of files that hold secrets; examples and templates do not.
SECRET_NAME = r"(?i)^(\.env([.-](?!example$|sample$|template$|dist$|tpl$)[\w-]+)*|\.envrc|\.?(npmrc|pypirc|netrc|pgpass)|id_(rsa|dsa|ecdsa|ed25519)([_-][\w-]+)?|\.?(credentials|auth|secrets?|service-account[\w-]*)\.json|\.?(credentials|secrets?)\.ya?ml|\.git-credentials|[\w.-]*\.(tfstate(\.backup)?|tfvars(\.json)?)|[\w.-]*(private|secret)[\w.-]*\.key|(server|tls|ssl|client|master)\.key)$"
SECRET_EXTENSIONS = [".pem", ".p12", ".pfx", ".keystore", ".jks"]
SECRET_PLACES = [".aws/credentials", ".docker/config.json", ".kube/config", "gh/hosts.yml", "gh/hosts.yaml", "glab-cli/config.yml", "glab-cli/config.yaml"]


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def path_filter(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), covered: Column | None = None) -> Column:
    """Any of ``include`` and none of ``exclude`` as literal, case-sensitive parts; only uncovered rows if ``covered`` is given."""
    kept = any_of([F.contains(path, F.lit(x)) for x in include]) if include else F.lit(True)
    kept &= ~any_of([F.contains(path, F.lit(x)) for x in exclude])
    return kept if covered is None else kept & ~covered


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_secret_name(path: Column) -> Column:
    name = name_of(path)
    last = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    return name.rlike(SECRET_NAME) | last.isin(SECRET_EXTENSIONS) | F.substring_index(path, "/", -2).isin(SECRET_PLACES)


def is_text_by_name(path: Column) -> Column:
    name = name_of(path)
    last = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    two = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+\.[^.]+)$", 1))
    named = name.isin(SKIP_NAMES) | F.lower(name).isin(SKIP_NAMES)
    return ~(named | is_secret_name(path) | last.isin(SKIP_EXTENSIONS) | two.isin(SKIP_EXTENSIONS))


def in_skipped_folder(path: Column) -> Column:
    """A folder on the way is skipped by name or begins with a point."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.exists(folders, lambda x: x.isin(SKIP_FOLDERS) | x.rlike(r"^\.[^.]"))


def is_text_by_content(content: Column, most: int | None = 1_000_000, probe: int | None = 8192) -> Column:
    """Not too long, and no zero byte at the beginning; None sets no bound and looks at every byte."""
    clean = ~F.contains(content if probe is None else F.substring(content, 1, probe), F.lit(b"\0"))
    return clean if most is None else (F.octet_length(content) <= most) & clean


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ** crosses folders, * and ? do not."""
    out, k = [], 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
        elif glob.startswith("**", k):
            out.append(".*")
            k += 2
        elif glob[k] == "{" and "}" in glob[k:]:
            end = glob.index("}", k)
            out.append("(?:" + "|".join(glob_pattern(x)[1:-1] for x in glob[k + 1 : end].split(",")) + ")")
            k = end + 1
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k])))
            k += 1
    return "^" + "".join(out) + "$"


def matches_glob(path: Column, globs: Sequence[str]) -> Column:
    return any_of([path.rlike(glob_pattern(g)) for g in globs])
