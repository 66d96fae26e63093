"""What a path (and the head of a file) says: language, test, config, generated, skipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension -> language.
EXTENSIONS = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript",
    "cjs": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "csharp", "php": "php",
    "sh": "bash", "bash": "bash", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "scala": "scala", "lua": "lua",
    "r": "r", "pl": "perl", "pm": "perl", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hrl": "erlang",
    "hs": "haskell", "ml": "ocaml", "mli": "ocaml", "clj": "clojure", "cljs": "clojure", "dart": "dart", "zig": "zig",
    "nim": "nim", "jl": "julia", "sql": "sql", "html": "html", "htm": "html", "css": "css", "scss": "scss", "vue": "vue",
    "svelte": "svelte", "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json", "md": "markdown",
    "markdown": "markdown", "dockerfile": "dockerfile", "make": "make", "cmake": "cmake", "proto": "proto",
    "graphql": "graphql", "gql": "graphql", "tf": "hcl", "groovy": "groovy",
}
# Interpreter of a shebang line -> language.
INTERPRETERS = {
    "python": "python", "python3": "python", "node": "javascript", "bash": "bash", "sh": "bash", "zsh": "bash",
    "ruby": "ruby", "perl": "perl", "php": "php",
}
# Whole file name -> language.
NAMES = {"dockerfile": "dockerfile", "makefile": "make", "gnumakefile": "make", "cmakelists.txt": "cmake"}
# Languages with symbol extraction, and how they are written.
DISPLAY_NAMES = {
    "python": "Python", "typescript": "TypeScript", "tsx": "TSX", "javascript": "JavaScript", "go": "Go", "rust": "Rust",
    "java": "Java", "ruby": "Ruby", "c": "C", "cpp": "C++", "csharp": "C#", "php": "PHP", "bash": "Bash",
}
# Names and folders of tests.
TEST_NAME = r"(^test_|_test\.|\.test\.|^.+\.spec\.|^.+_spec\.|^test\..*|tests?$)"
TEST_FOLDERS = ("test", "tests", "__tests__", "spec", "specs", "testing")
# Names and extensions of configuration.
CONFIG_NAMES = (
    "dockerfile", "makefile", "gnumakefile", "pyproject.toml", "setup.py", "setup.cfg", "package.json",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.mod", "go.sum", "cargo.toml", "cargo.lock", "gemfile",
    "gemfile.lock", "rakefile", "tsconfig.json", "tslint.json", ".eslintrc.json", ".prettierrc", ".prettierrc.json",
    "vite.config.ts", "vite.config.js", "webpack.config.js", "rollup.config.js", "babel.config.js", "jest.config.js",
    "jest.config.ts", "tox.ini", "pytest.ini", "ruff.toml", "uv.lock", "poetry.lock", "pipfile", "pipfile.lock",
    "requirements.txt", "cmakelists.txt", ".gitignore", ".dockerignore",
)
CONFIG_EXTENSIONS = ("toml", "yaml", "yml", "ini", "cfg", "conf", "env", "properties", "tf", "tfvars")
# What marks a generated file, by folder and in its first 2,048 characters.
GENERATED_FOLDERS = ("/generated/", "/__generated__/", "/dist/", "/build/")
GENERATED_HEAD = r"(?i)(@?generated|do not (modify|edit|change)|this file is automatically generated|autogenerated|code generated by)"
HEAD_CHARS = 2048
# Folders that are never read.
SKIPPED_FOLDERS = (
    ".git", ".source", "node_modules", "vendor", "target", "dist", "build", ".venv", "venv", "__pycache__",
    ".pytest_cache", ".ruff_cache", ".ty_cache", ".mypy_cache", ".next", ".nuxt", ".cache", ".idea", ".vscode",
)
# Extensions taken for binary where no content is at hand.
BINARY_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "ico", "bmp", "tiff", "webp", "avif", "svg", "pdf", "ai", "psd", "sketch", "zip", "tar",
    "gz", "bz2", "7z", "rar", "xz", "tgz", "tbz", "zst", "exe", "dll", "so", "dylib", "a", "lib", "o", "obj", "class",
    "jar", "war", "wasm", "pyc", "pyd", "whl", "egg", "woff", "woff2", "ttf", "otf", "eot", "mp3", "mp4", "mov", "avi",
    "mkv", "flac", "wav", "ogg", "webm", "m4a", "m4v", "iso", "img", "dmg",
)
SNIFF_BYTES, MAX_FILE_BYTES = 8192, 2 * 1024 * 1024


def _lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value for ``key``, null where it has none."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def basename(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def extension(path: Column) -> Column:
    """In lower case and without the dot; null for a name without one."""
    name = basename(path)
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))


def language(path: Column, first_line: Column | None = None) -> Column:
    """By whole name, then extension, then shebang; empty if none is known."""
    known = [_lookup(NAMES, basename(path)), _lookup(EXTENSIONS, extension(path))]
    if first_line is not None:
        line = F.regexp_replace(F.substring(first_line, 3, 1_000_000), r"^\s*(/usr/bin/env\s+)?\s*", "")
        program = F.lower(F.substring_index(F.regexp_extract(line, r"^(\S*)", 1), "/", -1))
        known.append(F.when(F.startswith(first_line, F.lit("#!")), _lookup(INTERPRETERS, program)))
    return F.coalesce(*known, F.lit(""))


def is_test(path: Column) -> Column:
    inside = F.arrays_overlap(folders(F.lower(F.replace(path, F.lit("\\"), F.lit("/")))), F.array(*[F.lit(x) for x in TEST_FOLDERS]))
    return (path != "") & (basename(path).rlike(TEST_NAME) | inside)


def is_config(path: Column) -> Column:
    return basename(path).isin(*CONFIG_NAMES) | F.coalesce(extension(path).isin(*CONFIG_EXTENSIONS), F.lit(False))


def is_generated(path: Column, content: Column | None = None) -> Column:
    folder = F.concat(F.lit("/"), F.lower(F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))), F.lit("/"))
    found = F.lit(False)
    for hint in GENERATED_FOLDERS:
        found = found | F.contains(folder, F.lit(hint))
    if content is not None:
        found = found | F.coalesce(F.substring(content, 1, HEAD_CHARS).rlike(GENERATED_HEAD), F.lit(False))
    return found


def in_skipped_folder(path: Column) -> Column:
    return F.arrays_overlap(folders(path), F.array(*[F.lit(x) for x in SKIPPED_FOLDERS]))


def looks_binary(content: Column) -> Column:
    """A NUL in the first bytes; unreadable (null) content counts as binary."""
    head = F.substring(content, 1, SNIFF_BYTES)
    return F.coalesce(F.position(F.lit(b"\x00"), head) > 0, F.lit(True))


def binary_by_name(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*BINARY_EXTENSIONS), F.lit(False))


def skip_reason(path: Column, size: Column, ignored: Column, extra_ignored: Column, binary: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """The first reason that holds, empty for a file that is analysed."""
    return (
        F.when(ignored, "gitignore").when(extra_ignored, "extra_ignore").when(size > max_bytes, "oversize").when(binary, "binary").otherwise("")
    )


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | path.rlike(p)
    return found
