"""Schemas of the graph's tables, and the registries of labels, relationship types and file types."""

from __future__ import annotations

PROPERTIES = "map<string,string>"
NODES = f"entityId string, kind string, name string, filePath string, language string, startLine int, endLine int, loc int, parentId string, properties {PROPERTIES}"
RELS = f"entityId string, type string, sourceId string, targetId string, weight int, properties {PROPERTIES}"

# Node labels.
LABELS = (
    "File", "Directory", "Class", "Interface", "Function", "Method",
    "Variable", "Parameter", "TypeAlias", "Import", "Export",
    "Component", "JSXElement", "JSXAttribute", "TailwindClass",
    "PythonModule", "PythonFunction", "PythonClass", "PythonMethod", "PythonParameter", "PythonVariable",
    "CFunction", "CppClass", "CppMethod", "IncludeDirective", "MacroDefinition",
    "JavaClass", "JavaInterface", "JavaMethod", "JavaField", "PackageDeclaration", "ImportDeclaration",
    "CSharpClass", "CSharpInterface", "CSharpStruct", "CSharpMethod", "Property", "Field", "NamespaceDeclaration", "UsingDirective",
    "GoFunction", "GoMethod", "GoStruct", "GoInterface", "PackageClause", "ImportSpec",
    "SQLSchema", "SQLTable", "SQLView", "SQLColumn", "SQLSelectStatement", "SQLInsertStatement", "SQLUpdateStatement", "SQLDeleteStatement", "SQLFunction", "SQLProcedure",
)
# A kind that is emitted beside them.
MORE_LABELS = ("JavaEnum",)

# Relationship types.
TYPES = (
    "CONTAINS", "IMPORTS", "EXPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "HAS_METHOD", "HAS_PARAMETER", "MUTATES_STATE", "HANDLES_ERROR",
    "DEFINES_COMPONENT", "RENDERS_ELEMENT", "USES_COMPONENT", "HAS_PROP", "USES_TAILWIND_CLASS",
    "PYTHON_IMPORTS", "PYTHON_CALLS", "PYTHON_DEFINES_FUNCTION", "PYTHON_DEFINES_CLASS", "PYTHON_HAS_METHOD", "PYTHON_HAS_PARAMETER",
    "INCLUDES", "DECLARES_PACKAGE", "JAVA_IMPORTS", "HAS_FIELD", "DECLARES_NAMESPACE", "USES_NAMESPACE", "HAS_PROPERTY", "GO_IMPORTS",
    "DEFINES_TABLE", "DEFINES_VIEW", "HAS_COLUMN", "REFERENCES_TABLE", "REFERENCES_VIEW", "CALLS_FUNCTION", "CALLS_PROCEDURE",
)
# Types that are emitted beside them.
MORE_TYPES = ("CSHARP_USING", "DEFINES_CLASS", "DEFINES_ENUM", "DEFINES_FUNCTION", "DEFINES_INTERFACE", "DEFINES_STRUCT", "RESOLVES_IMPORT")

# Extensions that are scanned, and which extractor each goes to.
PARSERS = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript", ".mjs": "typescript", ".cjs": "typescript",
    ".py": "python",
    ".c": "c_cpp", ".h": "c_cpp", ".cpp": "c_cpp", ".hpp": "c_cpp", ".cc": "c_cpp", ".hh": "c_cpp",
    ".java": "java",
    ".cs": "csharp",
    ".go": "go",
    ".sql": "sql",
}

# What a scan passes over.
IGNORES = (
    "**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/.next/**", "**/.svelte-kit/**",
    "**/.venv/**", "**/venv/**", "**/env/**", "**/__pycache__/**", "**/*.pyc", "**/bin/**", "**/obj/**", "**/*.class", "**/target/**",
    "**/*.log", "**/*.lock", "**/*.test.ts", "**/*.spec.ts", "**/*.test.tsx", "**/*.spec.tsx", "**/*.test.js", "**/*.spec.js",
    "**/playwright-report/**", "**/public/**", ".DS_Store",
)
