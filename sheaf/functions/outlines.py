"""Patterns that pick the outline of source code, and what becomes of each match.

Two kinds of language. For HTML, Rust, Java and Swift a list of patterns, one per kind
of chunk, gives chunks by kind. For the others one alternation reads the source from
start to end, strings and comments first so that nothing inside them counts, and gives
chunks in source order.

The patterns use no look-around. ``*+`` and ``++`` mark loops over whole groups that
must not go back, which keeps Java from recursing; other engines may read them as ``*``
and ``+``, with the same matches.
"""

from __future__ import annotations

SEPARATOR = "\n// -----\n"

# The patterns of the languages outlined kind by kind, in the order of
# their chunks, and what stands in where nothing is found.
BY_KIND = {
    "html": [
        ("doctype", r"<!DOCTYPE[^>]*>"),
        ("html", r"<html[^>]*>|</html>"),
        ("head", r"<head[^>]*>|</head>"),
        ("comment", r"<!--([\s\S]*?)-->"),
        ("body", r"<body[^>]*>|</body>"),
    ],
    "rust": [
        ("comment", r"//[^\n]*"),
        ("comment", r"/\*[\s\S]*?\*/"),
        ("import", r"use\s+[^;]+;"),
        ("struct", r"(?:pub\s+)?struct\s+\w+\s*\{[^}]*\}"),
        ("trait", r"(?:pub\s+)?trait\s+\w+\s*\{[^}]*\}"),
        ("enum", r"(?:pub\s+)?enum\s+\w+\s*\{[^}]*\}"),
        ("function", r"(?:pub\s+)?fn\s+\w+\s*\([^)]*\)(?:\s*->\s*[^{]+)?\s*\{"),
        ("impl", r"impl(?:\s+\w+)?\s+for\s+\w+\s*\{"),
    ],
    "java": [
        ("comment", r"//[^\n]*"),
        ("comment", r"/\*[\s\S]*?\*/"),
        ("package", r"package\s+[^;]+;"),
        ("import", r"import\s+[^;]+;"),
        (
            "class",
            r"(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+)?class\s+\w+(?:\s+extends\s+\w+)?(?:\s+implements\s+[^{]+)?\s*\{",
        ),
        ("interface", r"(?:public\s+|private\s+|protected\s+)?interface\s+\w+(?:\s+extends\s+[^{]+)?\s*\{"),
        ("enum", r"(?:public\s+|private\s+|protected\s+)?enum\s+\w+\s*\{"),
        (
            "method",
            r"(?:public\s+|private\s+|protected\s+)?(?:static\s+|final\s+|abstract\s+)*(?:<[^>]+>\s+)?(?:\w+(?:\[\])?\s+)?\w+\s*\([^)]*\)(?:\s+throws\s+[^{]+)?\s*\{",
        ),
    ],
    "swift": [
        ("comment", r"//[^\n]*"),
        ("comment", r"/\*[\s\S]*?\*/"),
        ("import", r"import\s+\w+"),
        ("struct", r"(?:public\s+|private\s+|fileprivate\s+|internal\s+)?struct\s+\w+(?::\s*[^{]+)?\s*\{"),
        ("class", r"(?:public\s+|private\s+|fileprivate\s+|internal\s+)?(?:final\s+)?class\s+\w+(?::\s*[^{]+)?\s*\{"),
        ("protocol", r"(?:public\s+|private\s+|fileprivate\s+|internal\s+)?protocol\s+\w+(?::\s*[^{]+)?\s*\{"),
        ("enum", r"(?:public\s+|private\s+|fileprivate\s+|internal\s+)?enum\s+\w+(?::\s*[^{]+)?\s*\{"),
        (
            "function",
            r"(?:public\s+|private\s+|fileprivate\s+|internal\s+)?(?:static\s+|class\s+)?func\s+\w+\s*\([^)]*\)(?:\s*->\s*[^{]+)?\s*\{",
        ),
        ("extension", r"extension\s+\w+(?::\s*[^{]+)?\s*\{"),
    ],
}
NONE_FOUND = {
    "html": "// No relevant HTML elements found after compression.\n",
    "rust": "// No relevant Rust elements found after compression.\n",
    "java": "// No relevant Java elements found after compression.\n",
    "swift": "// No relevant Swift elements found after compression.\n",
}
NONE_FOUND_ELSE = "// No relevant code found after compression.\n"
PLACEHOLDERS = {
    "go": " { ... }",
    "python": " { ... } # Body removed",
    "bash": " { ... } # Body removed",
    "javascript": " { ... } // Body removed",
    "c": " { ... } // Body removed",
}

# Building blocks. B is blank space within a line, W any white space.
B, W = r"[ \t]", r"[ \t\r\n\f]"
DOUBLE = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*+"'
SINGLE = r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*+'"
LINE_COMMENT, BLOCK_COMMENT = r"//[^\n]*", r"/\*[\s\S]*?\*/"
PARENS = r"\([^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*+\)[^()]*)*+\)"
BRACES = r"\{[^{}]*(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*+\}[^{}]*)*+\}"
BRACES2 = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*+\}"


def _any(*forms: str) -> str:
    return "(?m)" + "|".join(forms)


_BASH_PIECE = (
    r'"[^"\\]*(?:\\[\s\S][^"\\]*)*+"'
    r"|'[^']*'|\\[\s\S]|\$\(\([^()]*\)\)|\$\([^()]*\)|\$\{[^}]*\}|=\([^()]*\)|>&[0-9-]|&>"
    r"""|[^ \t\r\n\f"'\;|&#()]"""
)
_BASH_WORD = rf"(?:{_BASH_PIECE})(?:{_BASH_PIECE}|#)*+"

LEXERS = {
    "go": _any(
        LINE_COMMENT,
        BLOCK_COMMENT,
        DOUBLE,
        r"`[^`]*`",
        SINGLE,
        rf"^{B}*package{B}+\w+",
        rf"^{B}*import{B}*\([^)]*\)",
        rf"^{B}*import{B}+(?:[\w.]+{B}+)?(?:\"[^\"\n]*\"|`[^`]*`)",
        rf"^{B}*type{B}*{PARENS}",
        rf"^{B}*type{B}+\w+(?:\[[^\]\n]*\])?{B}*=?{B}*(?:struct|interface){B}*{BRACES}",
        rf"^{B}*type{B}+\w+[^\n]*",
        rf"^{B}*func{B}+(?:\([^)]*\){B}*)?\w+(?:\[[^\]\n]*\])?{PARENS}(?:[^{{\n]*(?:\{{\}}[^{{\n]*)*\{{|[^{{\n]*)",
    ),
    "python": _any(
        r"#[^\n]*",
        r'"""[\s\S]*?"""',
        r"'''[\s\S]*?'''",
        DOUBLE,
        SINGLE,
        rf"^{B}*import{B}+[^\n#;]+",
        rf"^{B}*from{B}+[\w.]+{B}+import{B}+(?:\([^)]*\)|[^\n#;]+)",
        rf"^{B}*(?:async{B}+)?def{B}+\w+(?:\[[^\]\n]*\])?{B}*{PARENS}[^:\n]*:",
        rf"^{B}*class{B}+\w+(?:\[[^\]\n]*\])?{B}*(?:{PARENS})?{B}*:",
    ),
    "javascript": _any(
        LINE_COMMENT,
        BLOCK_COMMENT,
        DOUBLE,
        SINGLE,
        r"`[^`\\]*(?:\\[\s\S][^`\\]*)*+`",
        rf"^{B}*import(?:{W}+[\w$*,{{}} \t\r\n]+from)?{W}*(?:\"[^\"\n]*\"|'[^'\n]*'){B}*;?",
        rf"^{B}*export{B}+default{B}+(?:async{B}+)?function{B}*\*?{B}*{PARENS}[^{{;\n]*\{{",
        rf"^{B}*export{B}+default{B}+class(?:{B}+extends{B}+[^{{\n]+)?{B}*\{{",
        rf"^{B}*(?:export{B}+(?:default{B}+)?)?(?:async{B}+)?function{B}*\*?{B}*[\w$]+(?:<[^>\n]*>)?{B}*{PARENS}[^{{;\n]*\{{",
        rf"^{B}*(?:export{B}+(?:default{B}+)?)?(?:abstract{B}+)?class{B}+[\w$]+(?:<[^>\n]*>)?(?:{B}+(?:extends|implements){B}+[^{{\n]+)?{W}*\{{",
        rf"^{B}*export{B}+(?:const|let|var){B}+[^;{{\n]*(?:{BRACES}[^;{{\n]*)?;?",
        rf"^{B}*export{B}*\{{[^}}]*\}}(?:{B}*from{B}*(?:\"[^\"\n]*\"|'[^'\n]*'))?{B}*;?",
        rf"^{B}*export{B}+default{B}+(?:[\w$]+|\"[^\"\n]*\"|'[^'\n]*'|{BRACES}|\[[^\]]*\]){B}*;?{B}*$",
        rf"^{B}*(?:const|let|var){B}+[\w$]+(?:{B}*:[^=\n]+)?{B}*={B}*(?:async{B}*)?(?:{PARENS}(?:{B}*:[^=\n]+)?|[\w$]+){B}*=>(?:{W}*\{{)?",
        rf"^{B}*(?:(?:public|private|protected|static|async|get|set|readonly|override){B}+)*\*?{B}*#?[\w$]+(?:<[^>\n]*>)?{B}*{PARENS}(?:{B}*:[^{{;\n]+)?{B}*\{{",
    ),
    "bash": _any(
        r"(?:^|[ \t])#[^\n]*",
        rf"^{B}*function{B}+[\w:.-]+{B}*(?:\({B}*\))?{W}*\{{",
        rf"^{B}*[\w:.-]+{B}*\({B}*\){W}*\{{",
        rf"{_BASH_WORD}(?:{B}+{_BASH_WORD})*+(?:{B}*\))?",
    ),
    "c": _any(
        LINE_COMMENT,
        BLOCK_COMMENT,
        rf"^{B}*#{B}*include{B}*(?:<[^>\n]*>|\"[^\"\n]*\")",
        rf"^{B}*#{B}*define{B}[^\n]*(?:\\\n[^\n]*)*+",
        DOUBLE,
        SINGLE,
        rf"\btypedef{W}+(?:struct|union|enum){W}*\w*{W}*{BRACES}[^;{{}}]*;",
        rf"\btypedef{W}[^;{{}}]*;",
        rf"^[A-Za-z_]\w*(?:[ \t*]+\w+)++{B}*{PARENS}{W}*\{{",
        rf"\b(?:struct|enum|union){W}+\w+(?:{W}*{BRACES})?",
    ),
    "css": _any(
        BLOCK_COMMENT,
        rf"@import{B}+(?:url\([^)]*\)|\"[^\"]*\"|'[^']*')[^;{{}}]*;",
        rf"@media[^{{}};]*{BRACES2}",
        rf"@(?:-\w+-)?keyframes[^{{}};]*{BRACES2}",
        r"@(?:supports|layer|container|document|scope)[^{};]*[{;]",
        rf"@[\w-]+[^{{}};]*(?:{BRACES2}|;)",
        r"[^{}@;/ \t\r\n\f][^{}@;]*\{[^{}]*\}",
    ),
}

# What a match is, by the first of these that it fits; a match that fits none is
# dropped, as are those of kind ''. ``{`` at the end marks a body to be cut off.
KINDS = {
    "go": [
        ("comment", r"\A/[/*]"),
        ("package", r"\Apackage"),
        ("import", r"\Aimport"),
        ("type", r"\Atype"),
        ("method", rf"\Afunc{W}*\("),
        ("function", r"\Afunc"),
    ],
    "python": [
        ("comment", r"\A#"),
        ("import", r"\A(?:import|from)\b"),
        ("class", r"\Aclass\b"),
        ("function", r"\A(?:async[ \t]+)?def\b"),
    ],
    "javascript": [
        ("comment", r"\A/[/*]"),
        ("", r"""\A["'`]"""),
        ("import", r"\Aimport\b"),
        ("", r"\A(?:if|for|while|switch|catch|with|else|do|try|return|function|await|new|typeof)\b"
             rf"(?:{B}*\(|{B}*\{{|{B}+(?:if|for|while|switch|catch)\b)"),
        ("class", r"\A(?:export[ \t]+(?:default[ \t]+)?)?(?:abstract[ \t]+)?class\b"),
        ("function", r"\A(?:export[ \t]+(?:default[ \t]+)?)?(?:async[ \t]+)?function\b"),
        ("export", r"\Aexport\b"),
        ("function", r"\A(?:const|let|var)\b"),
        ("method", r"\{\z"),
    ],
    "bash": [
        ("comment", r"\A#"),
        ("function", r"\{\z"),
        ("", r"\A(?:for|case|select|function|if|elif|while|until|then|else|do|!|time)\z"),
        ("", r"\A(?:for|case|select|in|fi|done|esac|local|declare|typeset|export|readonly|unset|\[\[?|\(\(|\{|\})(?:[ \t;]|\z)"),
        ("", r"\A[\w\[\]]+\+?="),
        ("", r"\A[^($]*\)\z"),
        ("", r"\A[{}<>0-9&=!*?:-]"),
        ("command", r"\A[\w./$~\"'@%+\\-]"),
    ],
    "c": [
        ("comment", r"\A/[/*]"),
        ("import", rf"\A#{B}*include"),
        ("", r"\A[#\"']"),
        ("typedef", r"\Atypedef\b"),
        ("", r"\A(?:else|return|do|case|goto|sizeof)\b"),
        ("function", r"\{\z"),
        ("struct", r"\Astruct\b"),
        ("enum", r"\Aenum\b"),
        ("union", r"\Aunion\b"),
    ],
    "css": [
        ("comment", r"\A/\*"),
        ("import", r"\A@import\b"),
        ("media", r"\A@media\b"),
        ("keyframes", r"\A@(?:-\w+-)?keyframes\b"),
        ("", r"\A@"),
        ("rule", r"\}\z"),
    ],
}
STRIP_KEYWORDS = r"\A(?:(?:if|elif|while|until|then|else|do|!|time)[ \t]+)+"
CSS_DECLARATION = r"[\w-]+[ \t]*:[^;{}]+;?"
CSS_RULE = r"[^{}@;/ \t\r\n\f][^{}@;]*\{[^{}]*\}"


def portable(pattern: str) -> str:
    """A pattern for engines without possessive loops."""
    return pattern.replace("*+", "*").replace("++", "+")


# Comments up to their end, in loops that Java runs through without a look back.
_COMMENTS = ((BLOCK_COMMENT, r"/\*(?:[^*]++|\*(?!/))*+\*/"), (r"<!--([\s\S]*?)-->", r"<!--(?:[^-]++|-(?!->))*+-->"))


def java(pattern: str) -> str:
    r"""A pattern as Java has to read it: lines end at ``\n`` alone, and a vertical tab
    is no white space."""
    for slow, fast in _COMMENTS:
        pattern = pattern.replace(slow, fast)
    body = pattern.replace(r"[\s\S]", "\0").replace(r"\s", W).replace("\0", r"[\s\S]")
    return "(?d)" + body
