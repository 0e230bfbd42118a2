"""Rules of the languages that are read line by line."""

from __future__ import annotations

from srcloom.extract.lines import Rule

_NOT = r"(?!\s*(?:return|new|else|throw|await|delete|case|goto|using|import|package|if|for|while|switch|catch|do|try|yield|typedef)\b)"
_JAVA = r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|abstract|static|final|sealed|strictfp|synchronized|native|default|transient|volatile)\s+)*"
_CS = r"^\s*(?:\[[^\]]*\]\s*)*(?:(?:public|protected|private|internal|abstract|static|sealed|partial|virtual|override|async|readonly|const|new|extern|unsafe|volatile|required)\s+)*"
_TYPE = r"(?!(?:public|protected|private|internal|static|final|abstract|override|virtual|async)\b)[\w.]+(?:<[^()=;]*>)?(?:\[\s*\])*\??"

GO = [
    Rule("PackageClause", r"^package\s+(\w+)", needs=("package",)),
    Rule("ImportSpec", r'^import\s+(?:([\w.]+)\s+)?"([^"]+)"', 2, 1, raw=True, needs=("import",)),
    Rule("ImportSpec", r'^\s+(?:([\w.]+)\s+)?"([^"]+)"\s*(?://.*)?$', 2, 1, raw=True, where="group = 'import'", needs=('"',)),
    Rule("GoMethod", r"^func\s+\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)\s*(\w+)\s*\(", 2, 1, body=True, needs=("func",)),
    Rule("GoFunction", r"^func\s+(\w+)\s*[\(\[]", body=True, needs=("func",)),
    Rule("GoStruct", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b", opens=True, needs=("type",)),
    Rule("GoInterface", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b", opens=True, needs=("type",)),
    Rule("GoStruct", r"^\s+(\w+)\s+struct\b", opens=True, where="group = 'type' and before = 0", needs=("struct",)),
    Rule("GoInterface", r"^\s+(\w+)\s+interface\b", opens=True, where="group = 'type' and before = 0", needs=("interface",)),
    Rule("TypeAlias", r"^type\s+(\w+)\s*=?\s*[\w*\[(]", needs=("type",)),
]
JAVA = [
    Rule("PackageDeclaration", r"^\s*package\s+([\w.]+)\s*;", needs=("package",)),
    Rule("ImportDeclaration", r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", needs=("import",)),
    Rule("JavaClass", _JAVA + r"(?:class|record)\s+(\w+)", opens=True, needs=("class", "record")),
    Rule("JavaInterface", _JAVA + r"@?interface\s+(\w+)", opens=True, needs=("interface",)),
    Rule("JavaEnum", _JAVA + r"enum\s+(\w+)", opens=True, needs=("enum",)),
    Rule("JavaMethod", _NOT + _JAVA + r"(?:<[^>]+>\s+)?(" + _TYPE + r")\s+(\w+)\s*\(", 2, 1, body=True, where="before > 0", needs=("(",)),
    Rule("JavaConstructor", _NOT + _JAVA + r"(\w+)\s*\([^;]*$", body=True, where="before > 0", needs=("(",)),
    Rule("JavaField", _NOT + _JAVA + r"(" + _TYPE + r")\s+(\w+)\s*(?:=|;|,)", 2, 1, where="before > 0", needs=("=", ";", ",")),
]
CSHARP = [
    Rule("NamespaceDeclaration", r"^\s*namespace\s+([\w.]+)", opens=True, needs=("namespace",)),
    Rule("UsingDirective", r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;", 2, 1, needs=("using",)),
    Rule("CSharpClass", _CS + r"class\s+(\w+)", opens=True, needs=("class",)),
    Rule("CSharpInterface", _CS + r"interface\s+(\w+)", opens=True, needs=("interface",)),
    Rule("CSharpStruct", _CS + r"struct\s+(\w+)", opens=True, needs=("struct",)),
    Rule("CSharpMethod", _NOT + _CS + r"(" + _TYPE + r")\s+(\w+)\s*(?:<[^>]*>)?\s*\(", 2, 1, body=True, where="before > 0", needs=("(",)),
    Rule("Property", _NOT + _CS + r"(" + _TYPE + r")\s+(\w+)\s*(?:\{|=>|$)", 2, 1, body=True, where="before > 0"),
    Rule("Field", _NOT + _CS + r"(" + _TYPE + r")\s+(\w+)\s*(?:=|;|,)", 2, 1, where="before > 0", needs=("=", ";", ",")),
]
C_CPP = [
    Rule("IncludeDirective", r'^\s*#\s*include\s*([<"])([^>"]+)[>"]', 2, 1, raw=True, needs=("include",)),
    Rule("MacroDefinition", r"^\s*#\s*define\s+(\w+)(?:\([^)]*\))?\s*(.*?)\s*$", 1, 2, raw=True, needs=("define",)),
    Rule("CppClass", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(\w+)\s*(?:final\s*)?(?::[^;]*)?\{?[^;]*$", opens=True, needs=("class",)),
    Rule("block", r"^\s*(?:namespace\b|extern\s)", 0, opens=True, needs=("namespace", "extern")),
    Rule("CFunction", _NOT + r"^\s*(?:template\s*<[^>]*>\s*)?(?:[\w:&*<>,~]+\s+)*[*&]*((?:\w+::)*~?\w+)\s*\([^;]*\)\s*(?:const\b|noexcept\b|override\b|final\b|\s)*(?::[^;{]*)?(?:\{.*)?$", body=True, where="not clean rlike '^\\\\s*(if|for|while|switch|catch|else|return|do)\\\\b'", needs=("(",)),
]
_MODS = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?"
TYPESCRIPT = [
    Rule("Import", r"""^\s*import\s+(?:type\s+)?(?:(.*?)\s+from\s*)?['"]([^'"]+)['"]""", 2, 1, raw=True, needs=("import",)),
    Rule("Class", rf"^{_MODS}class\s+(\w+)(.*)$", 1, 2, opens=True, where="before = 0", needs=("class",)),
    Rule("Interface", rf"^{_MODS}interface\s+(\w+)(.*)$", 1, 2, opens=True, where="before = 0", needs=("interface",)),
    Rule("TypeAlias", rf"^{_MODS}(?:const\s+)?(type|enum)\s+(\w+)", 2, 1, body=True, where="before = 0", needs=("type", "enum")),
    Rule("Function", rf"^\s*{_MODS}(?:async\s+)?function\s*\*?\s*(\w+)", body=True, needs=("function",)),
    Rule("Function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>", body=True, needs=("=>",)),
    Rule("Function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?function\b", body=True, needs=("function",)),
    Rule("Variable", r"^(?:export\s+)?(const|let|var)\s+(\w+)", 2, 1, where="before = 0", needs=("const", "let", "var")),
    Rule("Method", _NOT + r"^\s*(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)\s+)*\*?(?!constructor\b)(#?\w+)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::\s*[^{;]+)?\{", body=True, where="before = 1", needs=("{",)),
    Rule("Signature", r"^\s*(\w+)\??\s*(?:<[^>]*>)?\([^)]*\)\s*:\s*([^;,]+)[;,]?\s*$", 1, 2, where="before = 1", needs=(":",)),
]
