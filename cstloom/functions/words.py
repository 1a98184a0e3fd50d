"""Fixed word lists and tables of the analytics functions."""

#: Words that are no keywords, by origin.
PROGRAMMING_STOPWORDS = (
    "function class def return if else for while try catch finally import from as with pass break continue yield async await lambda global "
    "nonlocal assert del exec print len str int float bool list dict set tuple range enumerate zip map filter reduce any all sum max min "
    "const let var true false null undefined this new typeof instanceof constructor prototype extends super static public private protected "
    "abstract interface enum namespace module export default"
).split()
ENGLISH_STOPWORDS = (
    "the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should may might can "
    "must this that these those i you he she it we they me him her us them"
).split()
STOPWORDS = sorted(set(PROGRAMMING_STOPWORDS) | set(ENGLISH_STOPWORDS))

#: Terms that a context adds to the candidates.
CONTEXT_TERMS = {
    "function": ["function", "method", "procedure", "routine"],
    "class": ["class", "object", "type", "struct"],
    "file": ["module", "package", "library"],
    "variable": ["variable", "field", "property", "attribute"],
}

#: The language of each extension.
EXTENSION_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".rs": "rust", ".go": "go", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp",
    ".c": "c", ".h": "c", ".hpp": "cpp", ".hxx": "cpp", ".java": "java", ".cs": "csharp", ".ts": "typescript", ".tsx": "tsx",
}

#: Parts of a path that exclude it from a scan.
EXCLUDED_PATHS = [".git", ".svn", "__pycache__", "node_modules", "target", "build", "dist", ".next", ".terraform"]

#: Node types that become chunks.
SEMANTIC_TYPES = [
    "function_definition", "async_function_definition", "class_definition", "function_declaration", "method_definition", "class_declaration", "arrow_function", "function_expression",
    "method_declaration", "interface_declaration", "struct_specifier", "class_specifier", "function_item", "struct_item", "impl_item", "trait_item", "type_declaration",
]
