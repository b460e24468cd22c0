"""The queries of these operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import ann, bpe, chat, collocations, licenses, line_dedup, mixing, pii, shingle_join, spotsigs, toxicity, url_filter, variants
from sheaf.llm.common import read, whole

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    decoded = bpe.decode(encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "ids"), ranks)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


HARD_CONV, HARD_TEXT = -7, "</s>[INST] ok [/INST]"


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(HARD_CONV).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HARD_TEXT).alias("text"),
    )
    formatted = chat.format_chats(turns.unionByName(hard))
    back = formatted.select(
        "conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.learnt(F.col("formatted"), F.col("loss_mask")).alias("loss")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_length(column: str) -> str:
    """Code points of a text once its backslashes and control strings are escaped."""
    more = [f"(len({column}) - len(replace({column}, '{c}', ''))) // {len(c)}" for c in ("\\", *chat.CONTROL)]
    return " + ".join([f"len({column})", *more])


SQL["op7_chat"] = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT {HARD_CONV}, turn, CASE turn WHEN 0 THEN 'user' ELSE 'assistant' END, '{HARD_TEXT}' FROM range(2) t(turn)
), marked AS (
    SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text)
        THEN 0 ELSE {len(chat.OPEN + chat.CLOSE)} + {_escaped_length('role')} END AS head FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(head + {len(chat.BREAK)} + {_escaped_length('text')}) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated(docs).select("doc_id", F.col("n_dropped").cast("long").alias("n_dropped"), "text")


def line_dedup_sql(docs: str, min_words: int = line_dedup.MIN_WORDS) -> str:
    """Common table expressions for ``deduped``: ``docs`` (unique ids) without repeated runs."""
    ahead = f"(PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {min_words - 1} FOLLOWING)"
    return f"""
split AS (
    SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS s FROM {docs}
), worded AS (
    SELECT *, len(list_filter(regexp_split_to_array(s, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS n FROM split
), placed AS (
    SELECT doc_id, line, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos,
        CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY line) - n AS BIGINT) AS before FROM worded WHERE n > 0
), windows AS (
    SELECT doc_id, pos, md5(CAST(list(s) OVER {ahead} AS VARCHAR)) AS win, sum(n) OVER {ahead} AS words FROM placed
), firsts AS (
    SELECT win, min({{'doc_id': doc_id, 'pos': pos}}) AS f FROM windows WHERE words >= {min_words} GROUP BY win HAVING count(*) > 1
), runs AS (
    SELECT DISTINCT w.doc_id, f.doc_id AS source, w.pos - f.pos AS shift FROM windows w JOIN firsts USING (win)
    WHERE words >= {min_words} AND {{'doc_id': w.doc_id, 'pos': w.pos}} > f
), equal AS (
    SELECT r.*, a.pos, a.line, a.n, a.pos - row_number() OVER (PARTITION BY r.doc_id, source, shift ORDER BY a.pos) AS island
    FROM runs r JOIN placed a ON a.doc_id = r.doc_id JOIN placed b ON b.doc_id = source AND b.pos = a.pos - shift AND b.s = a.s
), summed AS (
    SELECT doc_id, line, sum(n) OVER (PARTITION BY doc_id, source, shift, island) AS words FROM equal
), gone AS (
    SELECT DISTINCT doc_id, line FROM summed WHERE words >= {min_words}
), deduped AS (
    SELECT doc_id, CAST(count(g.line) AS BIGINT) AS n_dropped,
        coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (g.line IS NULL), '') AS text
    FROM split LEFT JOIN gone g USING (doc_id, line) GROUP BY doc_id
)"""


SQL["op10_line_dedup"] = f"""
WITH {line_dedup_sql('documents')}
SELECT d.doc_id, coalesce(n_dropped, 0) AS n_dropped, x.text FROM documents d LEFT JOIN deduped x USING (doc_id)
"""


@query
def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.linked_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def components_sql(docs: str) -> str:
    """Common table expressions for ``sizes`` (doc_id, n_shingles) and ``roots`` (doc_id, component_id)."""
    return f"""
worded AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM {docs}
), shingled AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM worded
), sizes AS (
    SELECT doc_id, count(s) AS n_shingles FROM worded LEFT JOIN shingled USING (doc_id) GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b
), roots AS (
    SELECT doc_id, least(doc_id, coalesce(min(b), doc_id)) AS component_id FROM sizes LEFT JOIN reach ON a = doc_id GROUP BY doc_id
)"""


SQL["op6_shingle_join"] = f"""
WITH RECURSIVE {components_sql('documents')}
SELECT doc_id, n_shingles, component_id FROM sizes JOIN roots USING (doc_id)
"""


def toxic_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(toxicity.remainder() != 0)
    return toxicity.fit(docs, labels)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxic_model(docs, spark, sf_dir)).drop("text")
    held_out = F.coalesce(toxicity.remainder() == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


@query
def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = spotsigs.edited_prints(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return prints.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.digest(F.col("print")).alias("fingerprint"),
        spotsigs.digest(F.col("edited_print")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        spotsigs.likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


@query
def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.replace(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("n_entities").cast("long").alias("n_entities"), "text")


# Tokens by language, where a language is known only of documents that have labels.
TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def domain_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> mixing.Classifier | None:
    labelled = read(spark, sf_dir, "labels").select("doc_id").where("doc_id IS NOT NULL").distinct()
    return mixing.fit(docs.select("doc_id", "text", "lang"), "doc_id", "text", "lang", ids=labelled)


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = domain_model(docs, spark, sf_dir)
    if model is None:
        none = F.lit(None).cast("array<double>")
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_words"), none.alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    slim = mixing.with_posteriors(docs.select("doc_id", "text"), model, columns=["doc_id"])
    known = {d: w for d, w in TARGETS.items() if d in model.domains}
    rated = slim.withColumn("rate", mixing.rates(slim, model.domains, known))
    return rated.select("doc_id", "n_words", "posterior", "rate", mixing.copies(F.col("rate"), "doc_id").alias("copies"))


URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@query
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(url_filter.labelled_urls(), "url string, blocked int")
    rules = [url_filter.Rule.of(verdict, rule) for verdict, rule in URL_RULES]
    judged = url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), url_filter.fit(labelled), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.variants(docs).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("text", "lang"))


SQL["op11_collocations"] = """
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents
), worded AS (
    SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM piece
), total AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang
), gram AS (
    SELECT lang, array_to_string(g, ' ') AS phrase, len(g) AS k, count(*) AS f FROM (
        SELECT lang, unnest(list_concat(
            list_transform(range(1, len(w) + 1), lambda i: w[i:i]), list_transform(range(1, len(w)), lambda i: w[i:i + 1]),
            list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]), list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]))) AS g FROM worded)
    GROUP BY ALL HAVING count(*) >= 30
), candidate AS (
    SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM gram WHERE k > 1
), inside AS (
    SELECT lang, f, unnest(list_concat(
        list_transform(range(1, k), lambda i: array_to_string(w[i:i + 1], ' ')),
        CASE WHEN k > 3 THEN list_transform(range(1, k - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [] END)) AS phrase FROM candidate WHERE k > 2
), covered AS (
    SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL
), alone AS (
    SELECT c.* FROM candidate c LEFT JOIN covered v USING (lang, phrase) WHERE v.f IS NULL OR 100 * v.f < 80 * c.f
), cut AS (
    SELECT lang, phrase, f, w, unnest(range(1, k)) AS k FROM alone
), rated AS (
    SELECT c.lang, c.phrase, c.f, c.k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * c.f // (x.f + y.f) AS BIGINT) AS score FROM cut c
    JOIN gram x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN gram y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), best AS (
    SELECT lang, phrase, f AS a, l, r, score FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
