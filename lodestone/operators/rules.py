"""What declarations look like, per language: patterns over one statement's head.

A rule is ``(pattern, kind)``; group 1 of the pattern is the name. The first rule that
matches decides. Patterns are tables for the extraction in ``symbols``, not a parser.
"""

from __future__ import annotations

#: How a language's text falls into tokens, and what ends a statement.
C_STRINGS = r'"(?:\\.|[^"\\\n])*+"|\'(?:\\.|[^\'\\\n])*+\''
C_COMMENTS = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\z)"
_DIRECTIVES = {
    "typescript": r"^[ \t]*import\b[^;\"'\n]*(?:\{[^}]*\}[^;\"'\n]*)?[\"'][^\"'\n]*[\"'];?",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s[^;]*;",
    "php": r"^[ \t]*use\s[^;{(]*(?:\{[^}]*\})?\s*;",
    "c": r"^[ \t]*#(?:\\\n|[^\n])*",
}
TOKENS = {
    "brace": rf"(?m){C_COMMENTS}|{C_STRINGS}|`(?:\\.|[^`\\])*+`|[{{}};()\n]|[^{{}};()\n\"'`/]+|(?s:.)",
    "typescript": rf"(?m){_DIRECTIVES['typescript']}|{C_COMMENTS}|{C_STRINGS}|`(?:\\.|[^`\\])*+`|[{{}};()\n]|[^{{}};()\n\"'`/]+|(?s:.)",
    "rust": rf"(?m){_DIRECTIVES['rust']}|{C_COMMENTS}|\"(?:\\.|[^\"\\])*+\"|'(?:\\.|[^'\\\n])'|[{{}};()\n]|[^{{}};()\n\"'/]+|(?s:.)",
    "php": rf"(?m){_DIRECTIVES['php']}|{C_COMMENTS}|#(?!\[)[^\n]*|{C_STRINGS}|[{{}};()\n]|[^{{}};()\n\"'/#]+|(?s:.)",
    "c": rf"(?m){_DIRECTIVES['c']}|{C_COMMENTS}|{C_STRINGS}|[{{}};()\n]|[^{{}};()\n\"'/]+|(?s:.)",
    "python": r"(?m)#[^\n]*|\"\"\"(?s:.*?)(?:\"\"\"|\z)|'''(?s:.*?)(?:'''|\z)|" + C_STRINGS + r"|[{}()\[\];\n]|[^{}()\[\];\n\"'#]+|(?s:.)",
    "ruby": r"(?m)#[^\n{]*|" + C_STRINGS + r"|[;()\n]|[^;()\n\"'#]+|(?s:.)",
    "bash": r"(?m)(?<=^|[\s;])#[^\n]*|\"(?:\\.|[^\"\\])*+\"|'[^']*+'|\$\{[^}]*\}|[{}();\n]|[^{}();\n\"'#$]+|(?s:.)",
}
#: Languages without rules of their own: strings on one line, brackets, lines.
TOKENS["plain"] = rf"(?m){C_STRINGS}|[{{}};()\n]|[^{{}};()\n\"']+|(?s:.)"
#: In Go, what a list of declarations in parentheses begins with.
GO_GROUP = r"\A(?:const|var|type)[ \t]*\(\z"
TOKENS["go"] = r"(?m)^(?:const|var|type)[ \t]*\(|" + TOKENS["brace"].removeprefix("(?m)")
#: Lines of comment behind one another, from the first column on, are one token.
_RUNS = {family: r"//[^\n]*+" for family in ("brace", "typescript", "rust", "php", "c", "go")} | {
    "python": r"#(?!!?\[)[^\n]*+", "bash": r"#(?!!?\[)[^\n]*+", "ruby": r"#(?!!?\[)[^\n{]*+",
}
TOKENS |= {family: f"(?m)(?<![^\\n]){line}(?:\\n{line})*+|" + TOKENS[family].removeprefix("(?m)") for family, line in _RUNS.items()}
FAMILY = {
    "typescript": "typescript", "tsx": "typescript", "javascript": "typescript", "go": "go", "rust": "rust", "java": "brace",
    "c": "c", "cpp": "c", "csharp": "brace", "php": "php", "python": "python", "ruby": "ruby", "bash": "bash",
}
#: Languages whose blocks are told by indentation, and those where a line's end is a statement's.
INDENTED = ("python", "ruby")
LINEWISE = ("python", "ruby", "bash", "go", "typescript", "tsx", "javascript")

_TS = (
    (r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)", "class"),
    (r"^(?:export\s+)?(?:declare\s+)?interface\s+([\w$]+)", "interface"),
    (r"^(?:export\s+)?(?:declare\s+)?type\s+([\w$]+)[^=]*=", "type_alias"),
    (r"^(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+([\w$]+)", "enum"),
    (r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)", "function"),
    (r"^(?:export\s+)?(?:const|let|var)\s+([\w$]+)[^=]*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>", "function"),
    (r"^(?:export\s+)?(?:const|let|var)\s+([\w$]+)[^=]*=\s*(?:async\s+)?function\b", "function"),
    (r"^(?:export\s+)?(?:const|let|var)\s+([\w$]+)", "constant"),
    (r"^(?:(?:public|private|protected|static|readonly|override|abstract)\s+)*(constructor)\s*\(", "constructor"),
    (r"^(?:(?:public|private|protected|static|override|abstract)\s+)*(?:get|set)\s+([\w$]+)\s*\(", "property"),
    (r"^(?:(?:public|private|protected|static|override|abstract|async)\s+)*\*?\s*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|new\b|await\b)([\w$#]+)\s*(?:<[^(]*>)?\([^;]*\)\s*(?::[^;=]+)?$", "method"),
    (r"^(?:(?:public|private|protected|static|readonly|declare)\s+)*([\w$#]+)\s*[?!]?\s*(?::[^=]+)?(?:=.*)?$", "field"),
)
#: A declarator that is a function.
CALLABLE = r"^[^=]*=\s*(?:async\s+)?(?:function\b|(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>)"
#: Words that may stand before a shell command, and commands that only declare.
SHELL_AHEAD = ("if", "elif", "while", "until", "then", "do", "else", "time")
SHELL_DECLARES = ("local", "declare", "typeset", "readonly", "export", "unset", "source", ".", "{", "}", "fi", "done", "esac", "in")
RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "python": (
        (r"^class\s+(\w+)", "class"),
        (r"^(?:async\s+)?def\s+(\w+)", "function"),
        (r"^([A-Z][A-Z0-9_]*|[A-Z]\w*_\w*)\s*(?::[^=]+)?=(?!=)", "constant"),
        (r"^([A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)", "field"),
        (r"^([A-Za-z_]\w*)\s*:\s*[^=]+$", "field"),
    ),
    "typescript": _TS, "tsx": _TS, "javascript": _TS,
    "go": (
        (r"^package\s+(\w+)", "module"),
        (r"^func\s+\(\s*\w*\s*\*?\s*\w+[^)]*\)\s*(\w+)", "method"),
        (r"^func\s+(\w+)", "function"),
        (r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b", "class"),
        (r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b", "interface"),
        (r"^type\s+(\w+)", "type_alias"),
        (r"^const\s+(\w+)", "constant"),
        (r"^var\s+(?:\w+\s*,\s*)*?([A-Z]\w*)", "constant"),
        (r"^(\w+)\s+[\w.*\[\]]+(?:\s*`[^`]*`)?$", "field"),
    ),
    "rust": (
        (r"^(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(\w+)", "function"),
        (r"^(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "class"),
        (r"^(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "enum"),
        (r"^(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)", "interface"),
        (r"^(?:#\[[^\]]*\]\s*)*(?:unsafe\s+)?impl(?:\s*<[^{]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)", "impl"),
        (r"^(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)", "module"),
        (r"^(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(\w+)\s*:", "constant"),
        (r"^(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)", "type_alias"),
        (r"^macro_rules!\s*(\w+)", "macro"),
        (r"^(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:(?!:)\s*\S", "field"),
    ),
    "java": (
        (r"^package\s+([\w.]+)", "package"),
        (r"(?:^|\s)(?:class|record)\s+(\w+)", "class"),
        (r"(?:^|\s)@?interface\s+(\w+)", "interface"),
        (r"(?:^|\s)enum\s+(\w+)", "enum"),
        (r"^(?!.*=)(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected)\s+)?(?!return\b|new\b|throw\b|if\b|for\b|while\b|switch\b|catch\b|else\b)([A-Z]\w*)\s*\([^;]*\)\s*(?:throws[\w., ]+)?$", "constructor"),
        (r"^(?!.*=)(?:@\w+(?:\([^)]*\))?\s*)*(?!return\b|new\b|throw\b|else\b)(?:[\w<>\[\],.?]+\s+)+(\w+)\s*\([^;]*\)\s*(?:throws[\w., ]+)?$", "method"),
        (r"^(?=(?:.*\bstatic\b.*\bfinal\b|.*\bfinal\b.*\bstatic\b))(?:[\w<>\[\],.?]+\s+)+(\w+)\s*(?:=.*)?$", "constant"),
        (r"^(?!return\b|throw\b|break\b|continue\b|import\b)(?:[\w<>\[\],.?]+\s+)+(\w+)\s*(?:=.*)?$", "field"),
    ),
    "ruby": (
        (r"^module\s+([\w:]+)", "module"),
        (r"^class\s+([\w:]+)", "class"),
        (r"^def\s+(?:self\.)?([\w?!=]+)", "method"),
        (r"^([A-Z]\w*)\s*=(?!=)", "constant"),
    ),
    "c": (
        (r"^#\s*define\s+(\w+)", "constant"),
        (r"^(?:typedef\s+)?(?:struct|union)\s+(\w+)$", "class"),
        (r"^typedef\s+(?:struct|union|enum)\s*(\w*)$", "class"),
        (r"^typedef\b.*?(\w+)\s*$", "type_alias"),
        (r"^([A-Za-z_]\w*)$", "typedef_name"),
        (r"^enum\s+(\w+)", "enum"),
        (r"^(?!return\b|else\b|if\b|for\b|while\b|switch\b|typedef\b|case\b|.*=)(?:[\w*&:<>,~]+\s+[*&]*)+([\w:~]+)\s*\([^;]*\)\s*(?:const)?\s*$", "function"),
        (r"^(?!return\b|break\b|continue\b|goto\b|typedef\b|#)(?:[\w*:<>]+\s+[*&]*)+(\w+)(?:\[[^\]]*\])*\s*(?:=.*)?$", "field"),
    ),
    "csharp": (
        (r"^namespace\s+([\w.]+)", "module"),
        (r"(?:^|\s)(?:class|struct|record)\s+(\w+)", "class"),
        (r"(?:^|\s)interface\s+(\w+)", "interface"),
        (r"(?:^|\s)enum\s+(\w+)", "enum"),
        (r"^(?!.*=)(?:(?:public|private|protected|internal|static)\s+)+([A-Z]\w*)\s*\([^;]*\)\s*(?::\s*(?:base|this)\s*\([^)]*\))?$", "constructor"),
        (r"^(?!.*=)(?!return\b|new\b|throw\b|else\b|await\b|using\b)(?:[\w<>\[\],.?]+\s+)+(\w+)\s*(?:<[^(]*>)?\([^;]*\)\s*(?:where.*)?$", "method"),
        (r"^(?:(?:public|private|protected|internal|static|virtual|override|abstract|required|readonly)\s+)+[\w<>\[\],.?]+\s+(\w+)$", "property"),
        (r"^(?:(?:public|private|protected|internal|static|readonly|const)\s+)+[\w<>\[\],.?]+\s+(\w+)\s*(?:=.*)?$", "field"),
    ),
    "php": (
        (r"^(?:<\?php\s*)?namespace\s+([\w\\]+)", "package"),
        (r"^(?:<\?php\s*)?(?:(?:abstract|final|readonly)\s+)*(?:class|trait)\s+(\w+)", "class"),
        (r"^(?:<\?php\s*)?interface\s+(\w+)", "interface"),
        (r"^(?:<\?php\s*)?enum\s+(\w+)", "enum"),
        (r"^(?:<\?php\s*)?(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?\s*(\w+)", "function"),
        (r"^(?:<\?php\s*)?(?:(?:public|private|protected|final)\s+)*const\s+(?:\w+\s+)?(\w+)\s*=", "constant"),
        (r"^(?:(?:public|private|protected|static|readonly|var)\s+)+(?:[?\w|\\]+\s+)?\$(\w+)", "field"),
    ),
    "bash": (
        (r"^function\s+([\w:-]+)", "function"),
        (r"^([\w:-]+)\s*\(\s*\)", "function"),
        (r"^(?:export\s+|readonly\s+|declare\s+(?:-\w+\s+)*)?([A-Z][A-Z0-9_]*)=", "constant"),
    ),
}
RULES["cpp"] = (
    (r"^(?:inline\s+)?namespace\s+([\w:]+)", "module"),
    (r"^(?:template\s*<[^>]*>\s*)?class\s+(\w+)(?:\s+final)?(?:\s*:[^;]*)?$", "class"),
    *RULES["c"],
)
#: Kinds that hold others, and kinds that count only directly inside of such or of the file.
CONTAINERS = ("class", "interface", "enum", "module", "impl", "package")
DIRECT = ("field", "constant", "property", "type_alias")
#: ``(pattern, kind, group of the module)`` of imports.
IMPORTS: dict[str, tuple[tuple[str, str], ...]] = {
    "go": ((r"\"([^\"]+)\"", "import"),),
    "java": ((r"^import\s+static\s+([\w.*]+)", "static"), (r"^import\s+([\w.*]+)", "import")),
    "ruby": ((r"^require_relative\s+[\"']([^\"']+)", "from"), (r"^(?:require|load)\s+[\"']([^\"']+)", "import"), (r"^autoload\s+:\w+,\s*[\"']([^\"']+)", "import")),
    "c": ((r"^#\s*include\s*[<\"]([^>\"]+)", "import"),),
    "cpp": ((r"^#\s*include\s*[<\"]([^>\"]+)", "import"),),
    "csharp": ((r"^using\s+static\s+([\w.]+)", "static"), (r"^using\s+(?:\w+\s*=\s*)?([\w.]+)$", "import")),
    "bash": ((r"^(?:source|\.)\s+[\"']?([^\s\"';]+)", "import"),),
}
#: Words before ``(`` that are no calls, and words that are no names of fields or methods.
NO_CALLS = (
    "if for while switch catch return sizeof elif else do case when until unless match loop fn func function def class new and or not in is"
    " await yield assert print_r lambda with except raise throw typeof instanceof super import require struct interface impl"
).split()
