"""Outlines of sources in ten languages, made from the whole texts of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.checks.base import q, table
from sheaf.functions import outlines as o
from sheaf.operators import outline as outlining
from sheaf.operators import stats

QUERIES, SQL = {}, {}

# One source per language. ID stands for the document's number, TEXT for its text with
# every line as a comment of the language.
TEMPLATES = {
    ".go": (
        "//TEXT\npackage pID\n\nimport \"fmt\"\n\nimport (\n\t\"os\"\n\t\"strings\"\n)\n\n/* block\n   comment */\n"
        "type SID struct {\n\tA int\n\tB struct {\n\t\tC int\n\t}\n}\n\ntype IDs = []string\n\n"
        "func (s *SID) Get(v int, f func(int) int) (string, error) {\n\tif v > 0 {\n\t\treturn \"func no() {\", nil\n\t}\n\t// inside\n\treturn `type no`, nil\n}\n\n"
        "func mainID() interface{} {\n\tfmt.Println(\"// not\", os.Args)\n\treturn nil\n}\n"
    ),
    ".py": (
        "#TEXT\nimport os\nfrom sys import (\n    argv,\n    path,\n)\n\nclass CID(dict):\n    \"\"\"def no(): # not\"\"\"\n"
        "    def get(self, a: int = 3, b={\"x\": (1, 2)}) -> dict:\n        # inside\n        if a:\n            return 'def no():'\n        return {}\n\n"
        "async def runID(x,\n        y):\n    print(f\"{x} # not\")\n"
    ),
    ".js": (
        "//TEXT\nimport { a as b, c } from 'm';\nimport 'side';\n\nexport class CID extends Base {\n  constructor(n) {\n    this.n = \"function no() {\";\n  }\n"
        "  get(a, { b = 1 }) {\n    if (a) {\n      return `// ${b}`;\n    }\n    for (const x of b) {\n    }\n  }\n}\n"
        "export function fID(x, y = g(1)) {\n  // inside\n  return x;\n}\nfunction* genID() {\n  yield 1;\n}\n"
        "const arrowID = async (a, b) => {\n  return a;\n};\nlet shortID = (x) => x * x;\nexport const vID = 42;\nexport { vID as w };\nexport default fID;\n"
    ),
    ".sh": (
        "#!/bin/bash\n#TEXT\nfunction greetID() {\n  local name=$1\n  echo \"Hello # not, $name\" # said\n}\n\nprocID()\n{\n  if [ -f \"$1\" ]; then\n"
        "    cat \"$1\" | grep -v 'x;y' > out 2>&1\n  fi\n}\nX=1\nexport PATH=/bin\nfor i in 1 2; do greetID \"$i\" && procID /tmp/fID; done\nexit 0\n"
    ),
    ".c": (
        "//TEXT\n#include <stdio.h>\n#include \"aID.h\"\n#define MAX(a) ((a) > 1 ? \\\n  \"x\" : 0)\n/* block */\nstruct PID {\n  int a;\n  struct { int b; } in;\n};\n"
        "enum CID { RED, GREEN };\ntypedef unsigned long uID;\ntypedef struct { int x; } tID;\nstatic int *runID(int a, char *b[]) {\n  // inside\n"
        "  if (a) {\n    struct PID p;\n    return \"int no() {\";\n  }\n  return 0;\n}\n"
    ),
    ".css": (
        "/*TEXT*/\n@import url('a;ID.css') screen;\n:root {\n  --c: #fff;\n}\n.aID > b:hover, c {\n  color: red; /* in */\n}\n"
        "@media (max-width: 9px) {\n  .aID {\n    top: 0;\n  }\n}\n@keyframes kID {\n  from { top: 0; }\n  to { top: 1px; }\n}\n@font-face {\n  src: x;\n}\n"
    ),
    ".html": (
        "<!DOCTYPE html>\n<html lang=\"x\">\n<head><title>ID</title></head>\n<body class=\"b\">\n<!--TEXT-->\n<header>h</header><script>f('<p>')</script>\n</body>\n</html>\n"
    ),
    ".rs": (
        "//TEXT\nuse std::io::{self, Read};\n/* block\n */\npub struct PID {\n    a: u32,\n}\npub trait TID {\n    fn go(&self);\n}\nenum EID { A, B }\n"
        "impl TID for PID {\n    fn go(&self) {\n    }\n}\nimpl PID {\n    pub fn newID(a: u32) -> Self {\n        PID { a }\n    }\n}\n"
    ),
    ".java": (
        "//TEXT\npackage a.bID;\nimport java.util.List;\n/** doc */\npublic final class CID extends Base implements X, Y {\n    private int a;\n"
        "    public static <T> T get(T a, int b) throws E {\n        if (b > 1) {\n            return a;\n        }\n        return null;\n    }\n}\ninterface IID extends J {\n}\nenum EID { A }\npublic enum FID {\n}\n"
    ),
    ".swift": (
        "//TEXT\nimport Foundation\n/* block */\npublic struct SID: Codable {\n}\nfinal class CID {\n    static func make(_ a: Int) -> CID {\n        return CID()\n    }\n}\n"
        "protocol PID {\n}\nenum EID: Int {\n}\nextension CID: PID {\n    func go() {\n    }\n}\n"
    ),
}
LANG_OF = {
    ".go": "go", ".py": "python", ".js": "javascript", ".sh": "bash", ".c": "c", ".css": "css",
    ".html": "html", ".rs": "rust", ".java": "java", ".swift": "swift",
}
_LINE = {"#": "\n#", "//": "\n//", "/*": "*/\n/*", "<!--": "-->\n<!--"}


def _line_start(ext: str) -> str:
    return {".py": "#", ".sh": "#", ".css": "/*", ".html": "<!--"}.get(ext, "//")


def code(spark, sf, ext: str):
    docs = table(spark, sf, "documents")
    lines = F.replace("text", F.lit("\n"), F.lit(_LINE[_line_start(ext)]))
    made = F.replace(F.replace(F.lit(TEMPLATES[ext]), F.lit("ID"), F.col("doc_id").cast("string")), F.lit("TEXT"), lines)
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(ext))
    return docs.select(path.alias("path"), made.alias("content"))


def code_sql(ext: str) -> str:
    lines = f"replace(text, chr(10), {q(_LINE[_line_start(ext)])})"
    made = f"replace(replace({q(TEMPLATES[ext])}, 'ID', CAST(doc_id AS VARCHAR)), 'TEXT', {lines})"
    return f"SELECT 'f' || doc_id || '{ext}' AS path, {made} AS content FROM documents"


_SP = r"[\s\x0B\x{85}\p{Z}]"


def trim_sql(c: str) -> str:
    return rf"regexp_replace({c}, '\A{_SP}+|{_SP}+\z', '', 'g')"


def found_sql(pattern: str, text: str = "content") -> str:
    return f"regexp_extract_all({text}, {q(o.portable(pattern))}, 0)"


def chunks_sql(lang: str) -> str:
    """The chunks of a language as a list of structs."""
    if lang in o.BY_KIND:
        parts = [
            f"list_transform({found_sql(p)}, lambda c: struct_pack(kind := '{k}', content := {trim_sql('c')}))"
            for k, p in o.BY_KIND[lang]
        ]
        out = parts[0]
        for part in parts[1:]:
            out = f"list_concat({out}, {part})"
        return out
    tidy = trim_sql("c")
    if lang == "bash":
        tidy = f"regexp_replace({tidy}, {q(o.STRIP_KEYWORDS)}, '')"
    kinds = " ".join(
        f"WHEN regexp_matches(c, {q(o.portable(p))}) THEN {q(k) if k else 'NULL'}" for k, p in o.KINDS[lang]
    )
    hole = q(o.PLACEHOLDERS.get(lang, ""))
    bare = rf"regexp_replace(c, '[ \t\r\n\f]*\{{\z', '')"
    body = r"(ends_with(c, '{') AND NOT regexp_matches(c, '\A(?:/[/*]|#)'))"
    if lang == "css":
        shown = "c"
    elif lang == "python":
        shown = rf"CASE WHEN regexp_matches(c, '\A(?:class|def|async)\b') THEN c || {hole} ELSE c END"
    elif lang == "javascript":
        arrow = r"regexp_replace(c, '\A(?:const|let|var)[ \t]+([\w$]+)[ \t]*=[ \t]*(?:async[ \t]*)?([^=\n]*?)[ \t]*=>\z', 'const \1 = \2 =>')"
        shown = rf"CASE WHEN {body} THEN {bare} || {hole} WHEN regexp_matches(c, '\A(?:const|let|var)\b') AND ends_with(c, '=>') THEN {arrow} || {hole} ELSE c END"
    else:
        shown = f"CASE WHEN {body} THEN {bare} || {hole} ELSE c END"
    tokens = f"list_transform({found_sql(o.LEXERS[lang])}, lambda c: {tidy})"
    structs = f"list_transform({tokens}, lambda c: struct_pack(kind := CASE {kinds} END, content := {shown}))"
    return f"list_filter({structs}, lambda s: s.kind IS NOT NULL AND s.content <> '')"


def joined_sql(lang: str) -> str:
    notice = q(o.NONE_FOUND.get(lang, o.NONE_FOUND_ELSE))
    return f"CASE WHEN len(chunks) = 0 THEN {notice} ELSE array_to_string(list_transform(chunks, lambda s: s.content || {q(o.SEPARATOR)}), '') END"


_ROWS = (
    "SELECT path, '{lang}' AS lang, CAST(unnest(range(len(chunks))) AS INT) AS chunk_no, unnest(list_transform(chunks, lambda s: s.kind)) AS kind, "
    "unnest(list_transform(chunks, lambda s: s.content)) AS content FROM (SELECT path, {chunks} AS chunks FROM ({code}))"
)
_PAGES = "SELECT url || '.html' AS path, html AS content FROM pages"


def _outline_query(ext: str, lang: str):
    def run(spark, sf):
        rows = code(spark, sf, ext)
        if lang == "html":
            pages = table(spark, sf, "pages").select(F.concat("url", F.lit(".html")).alias("path"), F.col("html").alias("content"))
            rows = rows.unionByName(pages)
        return outlining.outline_chunks(rows, lang)

    return run


for _ext, _lang in LANG_OF.items():
    _code = code_sql(_ext) + (f" UNION ALL {_PAGES}" if _lang == "html" else "")
    QUERIES[f"outline_{_lang}"] = _outline_query(_ext, _lang)
    SQL[f"outline_{_lang}"] = _ROWS.format(lang=_lang, chunks=chunks_sql(_lang), code=_code)


def all_code(spark, sf):
    """Every document in every language, and as text."""
    out = table(spark, sf, "documents").select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content")
    )
    for ext in TEMPLATES:
        out = out.unionByName(code(spark, sf, ext))
    return out


def outline(spark, sf):
    return outlining.outline(all_code(spark, sf)).select("path", "outline")


_EACH = {lang: f"SELECT path, content, {joined_sql(lang)} AS outline FROM (SELECT path, content, {chunks_sql(lang)} AS chunks FROM ({code_sql(ext)}))" for ext, lang in LANG_OF.items()}
QUERIES["outline"] = outline
SQL["outline"] = (
    "SELECT 'f' || doc_id || '.md' AS path, text AS outline FROM documents UNION ALL "
    + " UNION ALL ".join(f"SELECT path, outline FROM ({sql})" for sql in _EACH.values())
)


def outline_join(spark, sf):
    """Pages, those without a doctype or comment included, which have few chunks."""
    rows = table(spark, sf, "pages").select("url", F.col("html").alias("content"))
    rows = rows.unionByName(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("url"), F.col("text").alias("content")))
    found = outlining.chunks_of(F.col("content"), "html")
    return rows.select("url", found.alias("chunks")).select("url", outlining.outline_join(F.col("chunks"), F.lit("html")).alias("outline"))


QUERIES["outline_join"] = outline_join
SQL["outline_join"] = (
    f"SELECT url, {joined_sql('html')} AS outline FROM (SELECT url, {chunks_sql('html')} AS chunks FROM "
    "(SELECT url, html AS content FROM pages UNION ALL SELECT CAST(doc_id AS VARCHAR), text FROM documents))"
)


def outline_ratio(spark, sf):
    rows = outlining.outline(all_code(spark, sf))
    return stats.outline_ratio(rows, F.col("outline"))


QUERIES["outline_ratio"] = outline_ratio
SQL["outline_ratio"] = " UNION ALL ".join(
    f"SELECT '{lang}' AS lang, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS before, CAST(sum(strlen(outline)) AS BIGINT) AS after FROM ({sql})"
    for lang, sql in _EACH.items()
)
