"""Languages by file ending, lines at which code is cut, declarations that name a chunk, by language.

Every expression stands as it is matched. Lines of scripts are matched as they are, those of other languages without the
white space around them; expressions of symbols see the whole chunk, ``^`` being the start of a line.
"""

from __future__ import annotations

LANGUAGES: dict[str, str] = {
    ".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".cs": "csharp", ".fs": "fsharp", ".fsi": "fsharp", ".vb": "vbnet",
    ".swift": "swift", ".php": "php", ".scala": "scala", ".sc": "scala", ".dart": "dart", ".lua": "lua", ".rb": "ruby", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".xaml": "xaml", ".tf": "terraform", ".tfvars": "terraform", ".hcl": "hcl",
    ".md": "markdown", ".txt": "text", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".sh": "shell", ".sql": "sql",
}

#: Languages whose lines are matched as they are, and whose imports are grouped.
SCRIPTS: tuple[str, ...] = ("typescript", "javascript", "tsx", "jsx")
IMPORT = r"^(?:import\s|from\s|require\s*\()"
#: Starts of lines that belong to a declaration right below.
COMMENTS: tuple[str, ...] = ("//", "/*", "*", "*/", "#", '"""', "'''", "/**")
MORE_COMMENTS: dict[str, tuple[str, ...]] = {"csharp": ("[",), "fsharp": ("[",), "swift": ("@",), "scala": ("@",), "dart": ("@",), "php": ("#[",), "lua": ("--",)}
#: Where lines that start with ``@`` belong to a declaration below only if they hold nothing else.
ONLY_ANNOTATIONS: tuple[str, ...] = ("swift", "scala", "dart")
ANNOTATIONS = r"^(?:@\w+(?:\([^)]*\))?\s*)+$"

_TS = r"^(?:export\s+(?:default\s+)?(?:async\s+)?(?:function|class|interface|type|enum|const|let|var)\b|(?:async\s+)?function\s+\w+|class\s+\w+|interface\s+\w+|type\s+\w+\s*[=<]|enum\s+\w+|const\s+\w+\s*[:=]|let\s+\w+\s*[:=]|var\s+\w+\s*[:=]|(?:describe|it|test|beforeEach|afterEach|beforeAll|afterAll)\s*\(|module\.exports|exports\.\w+)"
_HCL = r"^(?:resource|data|module|variable|output|locals|provider|terraform|moved|import|check|removed)(?=\s+[^=\s])"
BOUNDARIES: dict[str, str] = {
    "python": r"^(?:(?:async\s+)?def\s+\w+|class\s+\w+|@\w+)",
    "typescript": _TS,
    "javascript": _TS,
    "tsx": _TS,
    "jsx": _TS,
    "go": r"^(?:func\s+(?:\(.*?\)\s*)?\w+|type\s+\w+|var\s+\(|const\s+\()",
    "rust": r"^(?:(?:pub(?:\(crate\))?\s+)?(?:async\s+)?fn\s+\w+|(?:pub(?:\(crate\))?\s+)?(?:struct|enum|trait|impl|mod|type)\s+\w+|#\[)",
    "java": r"^(?:(?:(?:public|protected|private|abstract|final|static|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record)\s+\w+|(?:(?:public|protected)\s+)?@interface\s+\w+|(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|transient|volatile)\s+)+(?:<[^>]+>\s+)?[\w<>\[\],? ]+(?:\[\])*\s+\w+\s*\()",
    "kotlin": r"^(?:(?:(?:public|internal|protected|private|abstract|final|open|sealed|data|inner|value|annotation)\s+)*(?:class|interface|object)\s+\w+|(?:(?:public|internal|protected|private)\s+)*enum\s+class\s+\w+|(?:(?:public|internal|protected|private|abstract|open|final|override|inline|infix|operator|tailrec|suspend|external|expect|actual)\s+)*fun\s+|(?:(?:public|internal|protected|private)\s+)*typealias\s+\w+)",
    "csharp": r"^(?:(?:(?:public|private|protected|internal|static|abstract|sealed|partial|new|unsafe)\s+)*(?:class|struct|interface|record)\s+\w+|(?:(?:public|private|protected|internal|new)\s+)*enum\s+\w+|(?:(?:public|private|protected|internal|static|virtual|override|sealed|new|abstract)\s+)*event\s+|(?:(?:public|private|protected|internal|static|abstract|virtual|override|sealed|new|extern|unsafe|async|partial)\s+)+(?:[\w<>\[\],?\s]+\s+)?\w+\s*[\(<]|(?:(?:public|private|protected|internal|static|abstract|virtual|override|sealed|new|extern|unsafe)\s+)+[\w<>\[\],? ]+(?:\[\])*\s+\w+\s*(?:\{|=>))",
    "fsharp": r"^(?:module\s+\w+|type\s+\w+|let\s+(?:rec\s+)?(?:inline\s+)?\w+|member\s+(?:\w+)\.\w+|interface\s+\w+|exception\s+\w+)",
    "vbnet": r"(?i)^(?:(?:(?:Public|Private|Protected\s+Friend|Private\s+Protected|Protected|Friend)\s+)?(?:(?:MustInherit|NotInheritable|Partial)\s+)*Class\s+\w+|(?:(?:Public|Friend)\s+)?Module\s+\w+|(?:(?:Public|Private|Protected|Friend)\s+)?Structure\s+\w+|(?:(?:Public|Private|Protected|Friend)\s+)?Interface\s+\w+|(?:(?:Public|Private|Protected|Friend)\s+)?Enum\s+\w+|(?:(?:Public|Private|Protected\s+Friend|Private\s+Protected|Protected|Friend)\s+)?(?:(?:Shared|Overridable|MustOverride|NotOverridable|Overrides|Overloads|Async|Static)\s+)*(?:Sub|Function)\s+\w+|(?:(?:Public|Private|Protected|Friend)\s+)?(?:(?:Shared|ReadOnly|WriteOnly)\s+)?Property\s+\w+)",
    "swift": r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|fileprivate|internal|open|final|static|class|override|mutating|nonmutating|nonisolated|indirect|async|distributed)\s+)*(?:class|struct|enum|protocol|actor|extension|func|typealias)\s+",
    "php": r"^(?:(?:(?:abstract|final|readonly)\s+)*(?:class|interface|trait|enum)\s+\w+|namespace\s+[\w\\]+|(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+\w+)",
    "scala": r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:private|protected|final|sealed|abstract|override|implicit|lazy|inline|opaque|open|case)(?:\[[\w.]+\])?\s+)*(?:case\s+class|case\s+object|class|object|trait|enum|def|type)\s+\w+",
    "dart": r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:(?:abstract|base|final|interface|sealed|mixin)\s+)*extension\s+type\s+\w+|(?:(?:abstract|base|final|interface|sealed|mixin)\s+)*extension\s+\w+|(?:(?:abstract|base|final|interface|sealed)\s+)*mixin\s+class\s+\w+|(?:base\s+)?mixin\s+\w+|enum\s+\w+|typedef\s+\w+|(?:(?:abstract|base|final|interface|sealed)\s+)*class\s+\w+|(?:const\s+)?factory\s+\w+(?:<[^>]*>)?(?:\.\w+)?\s*\(|(?:(?:external|static|abstract)\s+)*(?:void|int|double|num|bool|dynamic|never|Future(?:<[^>]*>)?|Stream(?:<[^>]*>)?|[A-Z]\w*(?:<[^>]*>)?)\??\s+\w+\s*(?:<[^>]*>)?\s*\()",
    "lua": r"^(?:local\s+function\s+\w+\s*\(|function\s+\w[\w.]*(?::\w+)?\s*\(|(?:local\s+)?[A-Z]\w*\s*=\s*\{\})",
    "terraform": _HCL,
    "hcl": _HCL,
}

_TS_SYMBOLS = [
    (r"^export\s+default\s+(?:async\s+)?function\s+(\w+)", "function"),
    (r"^export\s+default\s+class\s+(\w+)", "class"),
    (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"),
    (r"^(?:export\s+)?class\s+(\w+)", "class"),
    (r"^(?:export\s+)?interface\s+(\w+)", "interface"),
    (r"^(?:export\s+)?type\s+(\w+)\s*[=<]", "type"),
    (r"^(?:export\s+)?enum\s+(\w+)", "enum"),
    (r"^(?:export\s+)?const\s+(\w+)\s*[:=]", "const"),
]
#: The first expression of a language that is found names the chunk.
SYMBOLS: dict[str, list[tuple[str, str]]] = {
    "python": [(r"^(?:async\s+)?def\s+(\w+)", "function"), (r"^class\s+(\w+)", "class")],
    "typescript": _TS_SYMBOLS,
    "javascript": _TS_SYMBOLS,
    "tsx": _TS_SYMBOLS,
    "jsx": _TS_SYMBOLS,
    "go": [
        (r"^func\s+\(.*?\)\s+(\w+)", "method"),
        (r"^func\s+(\w+)", "function"),
        (r"^type\s+(\w+)\s+struct", "struct"),
        (r"^type\s+(\w+)\s+interface", "interface"),
        (r"^type\s+(\w+)\b", "type"),
    ],
    "rust": [
        (r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "function"),
        (r"^(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "struct"),
        (r"^(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "enum"),
        (r"^(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", "trait"),
        (r"^(?:pub(?:\([^)]*\))?\s+)?impl(?:\s*<[^>]*>)?\s+(\w+)", "impl"),
        (r"^(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)", "mod"),
        (r"^(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)", "type"),
    ],
    "c": [(r"^struct\s+(\w+)", "struct"), (r"^enum\s+(\w+)", "enum"), (r"^[\w][\w\s*]+[\s*]+(\w+)\s*\([^;]*\)\s*\{", "function")],
    "cpp": [(r"^class\s+(\w+)", "class"), (r"^struct\s+(\w+)", "struct"), (r"^enum\s+(?:class\s+)?(\w+)", "enum"), (r"^[\w][\w\s*:<>]+[\s*]+(\w+)\s*\([^;]*\)\s*\{", "function")],
    "java": [
        (r"^(?:(?:public|protected)\s+)?@interface\s+(\w+)", "annotation"),
        (r"^(?:(?:public|protected|private|abstract|final|static|sealed|non-sealed|strictfp)\s+)*record\s+(\w+)", "record"),
        (r"^(?:(?:public|protected|private|abstract|final|static|sealed|non-sealed|strictfp)\s+)*interface\s+(\w+)", "interface"),
        (r"^(?:(?:public|protected|private|abstract|final|static|sealed|non-sealed|strictfp)\s+)*enum\s+(\w+)", "enum"),
        (r"^(?:(?:public|protected|private|abstract|final|static|sealed|non-sealed|strictfp)\s+)*class\s+(\w+)", "class"),
        (r"^(?!(?:return|if|for|while|switch|catch|throw|new|else|do|try|case|assert|break|continue)\b)(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|transient|volatile)\s+)*(?:<[^>]+>\s+)?[\w<>\[\],? ]+(?:\[\])*\s+(\w+)\s*\(", "method"),
    ],
    "kotlin": [
        (r"data\s+class\s+(\w+)", "data_class"),
        (r"sealed\s+class\s+(\w+)", "sealed_class"),
        (r"sealed\s+interface\s+(\w+)", "sealed_interface"),
        (r"enum\s+class\s+(\w+)", "enum"),
        (r"^(?:(?:public|internal|protected|private|abstract|open|final|override|inline|infix|operator|tailrec|suspend|external|expect|actual)\s+)*interface\s+(\w+)", "interface"),
        (r"^(?:(?:public|internal|protected|private|abstract|open|final|override|inline|infix|operator|tailrec|suspend|external|expect|actual|inner|value|annotation)\s+)*class\s+(\w+)", "class"),
        (r"companion\s+object\s*(\w*)", "companion_object"),
        (r"object\s+(\w+)", "object"),
        (r"^(?:(?:public|internal|protected|private|abstract|open|final|override|inline|infix|operator|tailrec|suspend|external|expect|actual)\s+)*fun\s+(?:<(?:[^<>]|<[^<>]*>)*>\s+)?(?:\w+(?:<(?:[^<>]|<[^<>]*>)*>)?\.)?(\w+)", "function"),
        (r"typealias\s+(\w+)", "typealias"),
    ],
    "csharp": [
        (r"^\s*(?:(?:public|private|protected|internal|static|abstract|sealed|partial|new|unsafe|readonly)\s+)*record\s+struct\s+(\w+)", "record"),
        (r"^\s*(?:(?:public|private|protected|internal|static|abstract|sealed|partial|new|unsafe)\s+)*record\s+class\s+(\w+)", "record"),
        (r"^\s*(?:(?:public|private|protected|internal|static|abstract|sealed|partial|new|unsafe)\s+)*record\s+(\w+)", "record"),
        (r"^\s*(?:(?:public|private|protected|internal|new)\s+)*enum\s+(\w+)", "enum"),
        (r"^\s*(?:(?:public|private|protected|internal|static|new|readonly|unsafe)\s+)*struct\s+(\w+)", "struct"),
        (r"^\s*(?:(?:public|private|protected|internal|new)\s+)*interface\s+(\w+)", "interface"),
        (r"^\s*(?:(?:public|private|protected|internal|static|abstract|sealed|partial|new|unsafe)\s+)*class\s+(\w+)", "class"),
        (r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|sealed|new|abstract)\s+)*event\s+[\w<>\[\],? ]+\s+(\w+)", "event"),
        (r"^\s*(?:(?:public|private|protected|internal|static|abstract|virtual|override|sealed|new|extern|unsafe)\s+)+[\w<>\[\],? ]+(?:\[\])*\s+(\w+)\s*(?:\{|=>)", "property"),
        (r"^\s*(?:(?:public|private|protected|internal|static|abstract|virtual|override|sealed|new|extern|unsafe|async|partial)\s+)+(?:[\w<>\[\],? ]+\s+)?(\w+)\s*[\(<]", "method"),
    ],
    "fsharp": [
        (r"^type\s+(\w+)\s*=\s*(?:\||\n\s*\|)", "union"),
        (r"^type\s+(\w+)\s*=\s*\{", "record"),
        (r"(?i)\[<Interface>\][^\n]*\n\s*type\s+(\w+)", "interface"),
        (r"(?i)^type\s+(\w+)\s*=\s*interface", "interface"),
        (r"^module\s+(\w+)", "module"),
        (r"^exception\s+(\w+)", "exception"),
        (r"^type\s+(\w+)", "type"),
        (r"^\s*member\s+(?:\w+)\.(\w+)", "method"),
        (r"^let\s+(?:rec\s+)?(?:inline\s+)?(\w+)", "function"),
    ],
    "vbnet": [
        (r"(?i)^\s*(?:(?:Protected\s+Friend|Private\s+Protected|Public|Private|Protected|Friend)\s+)?(?:(?:Shared|Shadows|Partial)\s+)*Enum\s+(\w+)", "enum"),
        (r"(?i)^\s*(?:(?:Protected\s+Friend|Private\s+Protected|Public|Private|Protected|Friend)\s+)?(?:(?:Partial|Shadows)\s+)*Structure\s+(\w+)", "struct"),
        (r"(?i)^\s*(?:(?:Protected\s+Friend|Private\s+Protected|Public|Private|Protected|Friend)\s+)?(?:(?:Partial|Shadows)\s+)*Interface\s+(\w+)", "interface"),
        (r"(?i)^\s*(?:(?:Public|Friend)\s+)?Module\s+(\w+)", "module"),
        (r"(?i)^\s*(?:(?:Protected\s+Friend|Private\s+Protected|Public|Private|Protected|Friend)\s+)?(?:(?:MustInherit|NotInheritable|Partial|Shadows)\s+)*Class\s+(\w+)", "class"),
        (r"(?i)^\s*(?:(?:Protected\s+Friend|Private\s+Protected|Public|Private|Protected|Friend)\s+)?(?:(?:Shared|Default|ReadOnly|WriteOnly|Shadows|Overridable|NotOverridable|Overrides|Overloads)\s+)*Property\s+(\w+)", "property"),
        (r"(?i)^\s*(?:(?:Protected\s+Friend|Private\s+Protected|Public|Private|Protected|Friend)\s+)?(?:(?:Shared|Overridable|MustOverride|NotOverridable|Overrides|Overloads|Async|Static|Default|Shadows)\s+)*(?:Sub|Function)\s+(\w+)", "method"),
    ],
    "swift": [
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|fileprivate|internal|open|final)\s+)*extension\s+(\w+)", "extension"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|fileprivate|internal|open|final|distributed)\s+)*actor\s+(\w+)", "actor"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|fileprivate|internal)\s+)*protocol\s+(\w+)", "protocol"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|fileprivate|internal|indirect)\s+)*enum\s+(\w+)", "enum"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|fileprivate|internal|final)\s+)*struct\s+(\w+)", "struct"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|fileprivate|internal|open|final)\s+)*class\s+(?!(?:func|var|let|struct|enum|protocol|actor|extension|typealias)\b)(\w+)", "class"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|fileprivate|internal|open|final|static|class|override|mutating|nonmutating|nonisolated|async|distributed)\s+)*func\s+(\w+)", "function"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|fileprivate|internal)\s+)*typealias\s+(\w+)", "typealias"),
    ],
    "xaml": [(r'x:Class="(?:[\w.]+\.)?(\w+)"', "view")],
    "php": [
        (r"^(?:(?:abstract|final|readonly)\s+)*interface\s+(\w+)", "interface"),
        (r"^(?:(?:abstract|final|readonly)\s+)*trait\s+(\w+)", "trait"),
        (r"^(?:(?:abstract|final|readonly)\s+)*enum\s+(\w+)", "enum"),
        (r"^(?:(?:abstract|final|readonly)\s+)*class\s+(\w+)", "class"),
        (r"^(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+(\w+)", "function"),
        (r"^namespace\s+([\w\\]+)", "namespace"),
    ],
    "scala": [
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:private|protected|final|sealed|abstract|override|implicit|lazy|inline|opaque|open)(?:\[[\w.]+\])?\s+)*case\s+class\s+(\w+)", "case_class"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:private|protected|final|sealed|abstract|override|implicit|lazy|inline|opaque|open)(?:\[[\w.]+\])?\s+)*case\s+object\s+(\w+)", "case_object"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:private|protected|final|sealed|abstract|override|implicit|lazy|inline|opaque|open)(?:\[[\w.]+\])?\s+)*trait\s+(\w+)", "trait"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:private|protected|final|sealed|abstract|override|implicit|lazy|inline|opaque|open)(?:\[[\w.]+\])?\s+)*object\s+(\w+)", "object"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:private|protected|final|sealed|abstract|override|implicit|lazy|inline|opaque|open)(?:\[[\w.]+\])?\s+)*class\s+(\w+)", "class"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:private|protected|final|sealed|abstract|override|implicit|lazy|inline|opaque|open)(?:\[[\w.]+\])?\s+)*enum\s+(\w+)", "enum"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:private|protected|final|sealed|abstract|override|implicit|lazy|inline|opaque|open)(?:\[[\w.]+\])?\s+)*def\s+(\w+)", "function"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:private|protected|final|sealed|abstract|override|implicit|lazy|inline|opaque|open)(?:\[[\w.]+\])?\s+)*type\s+(\w+)[^=\n]*=", "type"),
    ],
    "dart": [
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:abstract|base|final|interface|sealed|mixin)\s+)*extension\s+type\s+(\w+)", "extension_type"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:abstract|base|final|interface|sealed|mixin)\s+)*extension\s+(\w+)\s+on\b", "extension"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:abstract|base|final|interface|sealed)\s+)*mixin\s+class\s+(\w+)", "class"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:base\s+)?mixin\s+(\w+)\b", "mixin"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*enum\s+(\w+)", "enum"),
        (r"^typedef\s+(\w+)", "type"),
        (r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:abstract|base|final|interface|sealed|mixin)\s+)*class\s+(\w+)", "class"),
        (r"^\s*(?:const\s+)?factory\s+(\w+(?:\.\w+)?)\s*[(<]", "constructor"),
        (r"^(?:(?:external|static|abstract)\s+)*(?:void|int|double|num|bool|dynamic|never|Future(?:<[^>]*>)?|Stream(?:<[^>]*>)?|[A-Z]\w*(?:<[^>]*>)?)\??\s+(\w+)\s*(?:<[^>]*>)?\s*\(", "function"),
    ],
    "lua": [
        (r"^local\s+function\s+(\w+)\s*\(", "local_function"),
        (r"^function\s+(\w+:\w+)\s*\(", "method"),
        (r"^function\s+(\w+\.\w+)\s*\(", "method"),
        (r"^function\s+(\w+)\s*\(", "function"),
        (r"^(?:local\s+)?([A-Z]\w*)\s*=\s*\{\}", "module"),
    ],
    "ruby": [
        (r"^\s*module\s+([A-Z]\w*(?:::[A-Z]\w*)*)", "module"),
        (r"^\s*class\s+([A-Z]\w*(?:::[A-Z]\w*)*)", "class"),
        (r"^\s*def\s+(?:self\.)?([a-z_]\w*[!?=]?)", "method"),
        (r"^\s*attr_(?:reader|writer|accessor)\s+(?::)?([a-z_]\w*)", "attr"),
        (r"^\s*attr\b\s+(?::)?([a-z_]\w*)", "attr"),
        (r"^\s*([A-Z]\w*(?:::[A-Z]\w*)*)\s*=", "constant"),
    ],
}
