"""BPE, chats, line dedup, licence notices and personal data on small rows."""

import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sheaf.llm import bpe, chat, licenses, line_dedup, pii

TEXTS = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def theirs(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(rng, n):
    return "".join(rng.choice("abcthe  \n\t'sre12!?.é日\xa0\x1c𝒳") for _ in range(n))


def test_encoding_is_the_library_s(ranks, theirs):
    rng, own = random.Random(1), bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for _ in range(3000):
        text = noise(rng, rng.randint(0, 40))
        assert own.encode(text).tolist() == theirs.encode_ordinary(text)


def test_edits_and_appends(ranks, theirs):
    rng, own = random.Random(2), bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for _ in range(2000):
        text, new = noise(rng, rng.randint(0, 40)), noise(rng, rng.randint(0, 5))
        a = rng.randint(0, len(text))
        b = rng.choice([a, rng.randint(a, len(text)), len(text)])
        edited, ids = own.splice(text, own.encode(text).tolist(), a, b, new)
        assert edited == text[:a] + new + text[b:]
        assert ids == theirs.encode_ordinary(edited)


def test_pairs_stay_apart_as_merges_say(ranks):
    rng, p = random.Random(3), bpe.Pieces(ranks)
    some = [r for r in rng.sample(sorted(ranks.values()), 3000) if p.whole(r)]
    for a, b in zip(some, some[1:], strict=False):
        assert p._apart(a, b) == (p.merged(p.bytes[a] + p.bytes[b]) == [p.bytes[a], p.bytes[b]])


def test_tables_of_texts(spark, ranks, theirs):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (2, None, None), (3, "", "y"), (4, "long " * 30000, "z"), (None, "a\n\n b", "")]
    docs = spark.createDataFrame(rows, TEXTS)
    out = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == theirs.encode_ordinary(r.text or "") and r.bytes.decode() == (r.text or "")
    edits = bpe.encode(docs, ranks, public_tokenizers.PATTERN).selectExpr("*", "1 AS start", "cast(null AS int) AS stop", "'zz' AS new")
    for r in bpe.splice(edits, ranks, public_tokenizers.PATTERN).collect():
        assert r.ids == theirs.encode_ordinary(r.text)
    assert bpe.encode(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    odd = spark.createDataFrame([([0, None, -3, 999999],)], "ids array<int>")
    assert bpe.decode(odd, ranks).first().bytes == next(t for t, r in ranks.items() if r == 0)


def test_chats_come_back(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "[\\INST]\\\\", None, "", "<s>\\</s>"]
    rows = [(1, i, ["user", "assistant", "assistant", None, "system", "[INST]"][i % 6], t, "x") for i, t in enumerate(hard * 2)]
    rows += [(2, 0, "assistant", "b", "x"), (2, 0, "assistant", "a", "x"), (None, None, "user", "q", "x"), (2, 0, "assistant", "a", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(turns)
    back = out.select("conv_id", chat.turns_of(F.col("formatted")).alias("t"), chat.learnt(F.col("formatted"), F.col("loss_mask")).alias("l"))
    got = {r.conv_id: ([tuple(t) for t in r.t], r.l) for r in back.collect()}
    for conv in (1, 2, None):
        some = sorted(((r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert got[conv] == ([s[1:] for s in some], "".join(s[2] for s in some if s[1] == "assistant"))
    assert chat.format_chats(turns.limit(0)).count() == 0
    merged = out.where("conv_id = 2").first().formatted
    assert merged.count(chat.OPEN) == 1 and merged.count(chat.BREAK) == 3


def brute_lines(docs, least):
    lines = {i: [(k, s, len(s.split())) for k, s in enumerate(t.split("\n")) if s.split()] for i, t in docs}
    gone = {i: set() for i, _ in docs}
    for i, _ in docs:
        a = lines[i]
        for j, _ in docs:
            if j > i:
                continue
            b = lines[j]
            for x in range(len(a)):
                for y in range(len(b)):
                    if (j, y) >= (i, x) or (x and y and a[x - 1][1] == b[y - 1][1]):
                        continue
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n][1] == b[y + n][1]:
                        n += 1
                    if sum(w for _, _, w in a[x : x + n]) >= least:
                        gone[i] |= {k for k, _, _ in a[x : x + n]}
    return {i: "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs}


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(f"w{k}{j}" for j in range(rng.randint(1, 6))) for k in range(12)]
    docs = [(i, "\n".join(rng.choice([*pool, "", f"own {i}"]) for _ in range(rng.randint(1, 14)))) for i in range(40)]
    out = line_dedup.drop_repeated(spark.createDataFrame(docs, "doc_id long, text string"), min_words=8)
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(docs, 8)


def test_line_dedup_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\n{long}\nb", "p"), (2, f"{long}\nc", "q"), (2, f"{long}\nc", "q"), (3, None, "r"), (4, "", "s"), (None, long, "t"), (5, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string")
    out = sorted((r.doc_id or -1, r.text or "", r.n_dropped) for r in line_dedup.drop_repeated(docs).collect())
    # A row without id comes first, so its passage stays.
    assert out == [(-1, long, 0), (1, "a\nb", 1), (2, "c", 1), (2, "c", 1), (3, "", 0), (4, "", 0), (5, "", 1)]
    assert line_dedup.drop_repeated(docs.limit(0)).count() == 0


def test_notices(spark):
    rows = [
        (1, "x y z. Released under the MIT License. More", 1),
        (2, "LICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0.", 1),
        (3, "licensed under the Apache License, Version 1.1", 1),
        (4, "This work is hereby licensed under the GNU General Public License, version 3", 1),
        (5, None, 1), (6, "", 1), (7, "a license to kill " * 5000, 1), (None, "Licensed under CC BY-NC 4.0.", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert {k: r.license for k, r in got.items()} == {1: "mit", 2: "apache-2.0", 4: "gpl-3.0", None: "cc-by-nc-4.0"}
    assert rows[0][1][got[1].start : got[1].stop] == "Released under the MIT License" and got[1].coverage == 1.0
    assert "+hereby" in got[4].differences and got[4].saved > 0.3
    assert licenses.scan(docs.limit(0)).count() == 0


def test_notices_of_all_rights(spark):
    forms = {
        "All rights reserved.": "all-rights",
        "Copyright. All rights reserved.": "copyright",
        "Copyright (c) 2020 Foo Inc. All rights reserved.": "copyright",
        "© 1998-2020 The Foo and Bar Company of Somewhere, Ltd. ALL RIGHTS RESERVED": "all-rights",
        "Copyright " + "holder " * 60 + "All rights reserved.": "all-rights",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "All rights of way are shown.": None,
    }
    rows = [(i, f"Some prose.\n{form}\nMore of it") for i, form in enumerate(forms)]
    got = {i: (license, text) for i, license, text in (
        (r.doc_id, r.license, rows[r.doc_id][1][r.start : r.stop]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    )}
    assert {i: v[0] for i, v in got.items()} == {i: name for i, name in enumerate(forms.values()) if name}
    assert got[2][1] == "Copyright (c) 2020 Foo Inc. All rights reserved" and got[4][1] == "All rights reserved"


def test_notices_with_added_and_changed_words(spark):
    mit, apache = "Released under the MIT License", "Licensed under the Apache License, Version 2.0"
    forms = {
        "Licensed under the terms of the Apache License, Version 2.0": ["apache-2.0"],
        "Released under the terms of the MIT License": ["mit"],
        "Released under the MIT Licence": ["mit"],
        "Licenced under the well-known and liberal Apache Licence, Version 2.0": ["apache-2.0"],
        f"{mit}. {mit}.": ["mit", "mit"],
        f"{apache} or, as you like, released under the terms of the MIT licence": ["apache-2.0", "mit"],
        "Licensed under the terms of the Apache License, Version 1.1": [],
        "Licensed under the terms of the Apache License, Version 1.1 (2.0)": [],
        "Licensed under the Apache License, Version 1.1, or the Apache License, Version 2.0": ["apache-2.0"],
        "Redistributions and use in source and in binary forms, with or without any modification, are permitted provided that all of the following conditions are met": ["bsd"],
        "This work is licensed to you under the terms of the GNU Lesser General Public License, version 3": ["lgpl-3.0"],
        "The press of the university has a license to print": [],
    }
    around = "word stands by word and sentence by sentence in a text which is about trees and houses " * 5
    docs = spark.createDataFrame([(i, f"{around}. {form}. {around}") for i, form in enumerate(forms)], "doc_id long, text string")
    got = {i: [] for i in range(len(forms))}
    for r in sorted(licenses.scan(docs).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id].append(r)
    assert [[r.license for r in got[i]] for i in got] == list(forms.values())
    assert got[0][0].coverage == 1.0 and got[0][0].differences == ["+the", "+terms", "+of"]
    assert got[2][0].differences == ["-license", "+licence"]


def test_every_notice_of_the_table_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lines = {
        "All rights reserved.": "all-rights", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    }
    want = {(r.doc_id, name) for r in docs.where("text IS NOT NULL").collect() for line, name in lines.items() if line in r.text}
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert want and {name for _, name in want} == set(lines.values()) and got == want


def test_surrogates(spark):
    texts = {
        1: "mail Bob.72@Mail3.example.com, or call +1 (643) 555-5742.", 2: "bob.72@mail3.example.com; 4539 1488 0343 6467",
        3: 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" at 10.0.0.1', 4: "Maria Lopez and Иван Петров met Maria Lopez",
        5: None, 6: "", 7: "nothing 123 here", 8: "4539148803436467 and 9233a8ecf7c5b09fe5949719b6b82bc439e9329b " * 2000,
    }
    docs = spark.createDataFrame([*texts.items(), (2, texts[2])], "doc_id long, text string").withColumn("at", F.lit("x"))
    out = pii.replace(docs).collect()
    assert len(out) == 9
    got = {r.doc_id: r.text for r in out}
    assert got[5] is None and got[6] == "" and got[7] == texts[7]
    mail = re.search(r"\S+@\S+\.com", got[1]).group()
    assert mail.lower() in got[2] and mail[0].isupper() and "bob" not in got[1].lower()
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1]) and "5742" not in got[1]
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[2]).group().replace(" ", "")
    assert card in got[8] and card != "4539148803436467"
    digits = [int(c) for c in card[::-1]]
    assert (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0
    assert len(got[2]) == len(texts[2]) and len(got[8]) == len(texts[8])
    secret = re.search(r'"([0-9A-F]{40})"', got[3]).group(1)
    assert secret.lower() in got[8]
    a, b = re.match(r"(\w+ \w+) and (\w+ \w+) met ", got[4]).groups()
    assert got[4].endswith(a) and a.split()[0] in pii.GIVEN["female"] and b.split()[0] in pii.GIVEN["male_cyrillic"]
    assert pii.replace(docs.limit(0)).count() == 0


def test_surrogates_do_not_meet(spark):
    ips = [f"10.0.{i // 250}.{i % 250}" for i in range(600)] + ["1.2.3.4"]
    docs = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "doc_id long, text string")
    new = [r.text for r in pii.replace(docs).collect()]
    assert len(set(new)) == len(ips) and not set(new) & set(ips)
    many = spark.createDataFrame([("name", f"Anna {x}") for x in ("Bo", "Ba", "Da", "Do", "Du", "Ti", "To")], "kind string, canon string")
    made = [r.sur for r in pii.surrogates(many).collect()]
    assert len(set(made)) == 7


def test_guards_find_the_same_entities(spark):
    """Against the bare patterns, and not trying them all behind every letter."""
    rng = random.Random(5)
    forms = ["a@b.com", "x", "+", "(643) 555-5742", "555.123.4567", "10.0.0.1", "123-45-6789", "4539 1488", "0343 6467", "DE44", " 5001", "AKIA" + "Z" * 16,
             "f0" * 16, "Maria", " Lopez", "Иван Петров", "é", ".", "-", "_", " ", "\n", "1", "Q", "%", "("]
    texts = ["".join(rng.choice(forms) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = "|".join(f"(?:{p})" for p in pii.PATTERNS.values())
    found = [F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(n) for n, p in (("bare", bare), ("mine", pii.ANY))]
    got = rows.select(*found).collect()
    assert all(r.bare == r.mine for r in got) and sum(map(len, (r.mine for r in got))) > 3000
    assert pii.ANY.startswith(r"(?:(?<![A-Za-z])|")


def test_what_a_worker_remembers_is_small():
    """Parts, pieces and pairs, about 250 bytes each."""
    assert (bpe.PARTS + 2 * bpe.MEMO) * 250 < 128 << 20


def test_new_pieces_are_encoded_together(ranks, monkeypatch):
    """Finding op1_bpe: one walk over all new pieces, not one for each; what was asked for
    lately is not forgotten with the rest."""
    rng = random.Random(5)
    words = ["".join(rng.choice(["an", "é", "eau", "tion", "q", "ß", "x9", "字"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=200)) + rng.choice(["", "\n\n", "  ?!"]) for _ in range(40)] + ["", " ", "a"]
    slow = bpe.Pieces(ranks)
    wanted = [[i for p in bpe.Encoder(ranks, public_tokenizers.PATTERN).split(t) for i in slow.ids(p.encode())] for t in texts]
    monkeypatch.setattr(bpe.Pieces, "extend", None)
    monkeypatch.setattr(bpe, "PLACES", 64)
    own = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    own.piece.most = 500
    assert [ids.tolist() for ids in own.encode_all(texts)] == wanted
    assert [ids.tolist() for ids in own.encode_all(texts[::-1])] == wanted[::-1]
    assert len(own.piece) <= 250 and len(own.piece.before) <= 250
    made = []
    kept = bpe.Remembered(lambda p: made.append(p) or p.encode(), 4)
    for p in "abcadae":
        assert kept[p] == p.encode()
    assert made == list("abcde")
