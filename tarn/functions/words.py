"""Word lists and tables. All values in this module are fixed values: results depend on them as they are."""

# Words that a review query does not look for.
STOP_WORDS = tuple(
    """a about actually also an and are as at be been before but by can could did do does doing done for from get go had has
    have here how i if in into is it its just ll make maybe might more much need not of on or our out please probably really
    see should so some still sure than that the their there these they this those to up use using very was we what when why
    will with would you your""".split()
)

# Words too common in code to be feedback terms.
CODE_WORDS = tuple(
    """args call class cls code context data def false file files function line lines list module name none path result return
    self string test text true type value values""".split()
)

# Needles in a comment, and the text that they add to its query.
REVIEW_HINTS = (
    (("typo", "spelling", "spelled", "misspell"), "typo spelling naming"),
    (("rename", "name", "variable name"), "rename naming identifier"),
    (("delete", "remove", "redundant", "unnecessary", "cleanup"), "delete remove cleanup redundant"),
    (("except", "exception", "raise", "catch", "try"), "exception error handling raise catch"),
    (("sort", "ordering", "order"), "sort ordering order"),
    (("dependency", "import"), "dependency import module"),
    (("link", "docs", "documentation"), "docs link documentation"),
)

# Fixed values, as above, for the wider expansion.
EXPANSION_HINTS = (
    (("typo", "spelling", "spelled", "misspell", "grammar", "wording", "phrase"), "intent typo spelling wording text literal string message docs"),
    (("rename", "renamed", "naming", "variable name", "function name", "class name"), "intent rename naming identifier symbol variable function class api"),
    (("delete", "remove", "cleanup", "clean up", "redundant", "unnecessary", "unused"), "intent delete remove cleanup redundant unused simplify"),
    (("import", "dependency", "module", "package"), "intent import dependency module package"),
    (("except", "exception", "raise", "throw", "catch", "error handling", "try"), "intent exception error handling raise throw catch try"),
    (("sort", "ordering", "order", "deterministic"), "intent ordering sort deterministic stable"),
    (("comment", "doc", "docstring", "documentation", "readme"), "intent documentation comment docstring readme text"),
    (("optional", "none", "null", "nullable", "missing"), "intent optional none null missing default"),
    (("format", "style", "lint", "pep8", "spacing", "indent"), "intent formatting style lint spacing indent"),
)

# Needles of the intent flags that describe a comment to a router.
META_FLAGS = (
    ("intent_typo", ("typo", "spelled wrong", "spelling", "misspell")),
    ("intent_naming", ("variable name", "nicer variable", "rename", "name ", "named ")),
    ("intent_remove", ("remove", "delete", "redundant", "unnecessary", "comment this out")),
    ("intent_simplify", ("simplify", "just ", "instead", "nicer", "can we", "possible to")),
    ("intent_exception", ("exception", "try catch", "catch ", "raise ", "error", "typeerror")),
    ("intent_docs_text", ("docs", "documentation", "link", "wording", "style guide", "spelled", "word ")),
    ("intent_api_usage", ("import", "dependency", "undefined", "parameter", "argument", "callable", "function")),
)

# Needles that make fuzzy matching weigh near hits more.
TYPO_OR_NAMING = ("typo", "spelling", "spelled", "misspell", "rename", "name ", "named ")

# Languages by file extension.
LANGUAGES = {
    ".py": "Python", ".java": "Java", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript",
    ".go": "Go", ".rb": "Ruby", ".php": "PHP", ".cs": "CSharp", ".cpp": "CPP", ".cc": "CPP", ".cxx": "CPP", ".c": "C",
    ".h": "C/C++", ".hpp": "CPP", ".scala": "Scala", ".kt": "Kotlin", ".rs": "Rust", ".swift": "Swift", ".sh": "Shell",
    ".yml": "YAML", ".yaml": "YAML", ".md": "Markdown", ".rst": "RST",
}

# Structural attributes of a change, in the order in which they are told.
ATTRIBUTE_LABELS = {
    "anyInserted": "inserted tokens",
    "anyDeleted": "deleted tokens",
    "getMovedSrcs": "moved sources",
    "UpdatedSrcs": "updated sources",
    "AddedOrUpdatedComments": "comments updated",
    "UpdatedFuncArguments": "updated function arguments",
    "numOldFiles": "old files",
    "numNewFiles": "new files",
}
NO_ATTRIBUTES = "no notable structural code attributes"

# Weights of the features in the plain lexical score; BM25 has weight 1.
LEXICAL_WEIGHTS = {
    "line_overlap": 3.0,
    "lexical_overlap": 1.0,
    "inline_code_overlap": 1.5,
    "path_token_overlap": 0.0,
    "path_exact_match": 0.0,
    "inline_path_overlap": 0.75,
    "inline_line_overlap": 2.5,
    "word_tfidf": 1.5,
    "char_tfidf": 1.0,
    "quoted_span_exact": 3.0,
    "quoted_line_exact": 2.0,
}

# The base features in their order.
BASE_FEATURES = (
    "bm25", "line_overlap", "lexical_overlap", "inline_code_overlap", "path_token_overlap", "path_exact_match",
    "inline_path_overlap", "inline_line_overlap", "added_line_overlap", "removed_line_overlap", "changed_token_overlap",
    "added_token_overlap", "removed_token_overlap", "word_tfidf", "char_tfidf", "quoted_span_exact", "quoted_line_exact",
    "quoted_added_line_exact", "quoted_removed_line_exact", "replacement_pair_match", "replacement_old_removed",
    "replacement_new_added",
)
