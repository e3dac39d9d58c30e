"""The operators made of column expressions: chat, sharding, quality rules, licences."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest import DATA
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, licences, quality, queries, sharding
from tessera.llm.common import table

BITS = ["</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<|end|>", "<<SYS>>", "<", "\\", "[", "|", "a", "\n", "é", "<\\|end|>"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, agree):
    agree(queries.QUERIES[name], queries.ORACLES[name])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "odd<|text|>role", ""]), st.lists(st.sampled_from(BITS), max_size=8).map("".join)), min_size=1, max_size=4), min_size=1, max_size=5))
def test_any_text_survives(spark, convs):
    rows = [(i, t, role, text) for i, turns in enumerate(convs) for t, (role, text) in enumerate(turns)]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id")
    for r in chat.read_back(chat.format_chats(turns)).collect():
        assert [(t.role, t.text) for t in r.turns] == convs[r.conv_id]
        assert r.loss_text == "".join(t for role, t in convs[r.conv_id] if role == "assistant")
        assert r.formatted.count(chat.TURN) == len(convs[r.conv_id])


def test_layouts(spark):
    rows = [
        "named_struct('id', 1L, 'prompt', 'q', 'completion', 'a')",
        "named_struct('id', 1L, 'instruction', 'q', 'input', CAST(null AS string), 'output', 'a')",
        "named_struct('id', 1L, 'conversations', array(named_struct('from', 'human', 'value', 'q'), named_struct('from', 'gpt', 'value', 'a')), 'extra', 5)",
        "named_struct('id', 1L, 'messages', array(named_struct('role', 'user', 'content', 'q'), named_struct('role', 'assistant', 'content', 'a')))",
    ]
    for sql in rows:
        got = chat.canonical_turns(spark.sql(f"SELECT x.* FROM (SELECT {sql} AS x)"), "id").orderBy("turn").collect()
        assert [(r.role, r.text) for r in got] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.sql("SELECT 1L AS id, 'x' AS unheard"), "id")


def test_mixed_layouts_by_fingerprint(spark):
    """Three layouts' columns are there, flat and nested; each record's own fingerprint decides."""
    schema = "id long, prompt string, completion string, instruction string, output string, messages array<struct<role: string, content: string>>, turns int"
    rows = [(1, "q", "a", None, None, None, 1), (2, None, None, "do", "done", None, 1), (3, None, None, None, None, [("user", "hi"), ("assistant", None)], 1),
            (4, "p", None, None, None, None, 1), (5, "q", "a", "do", "done", None, 1), (6, None, None, None, None, [("user", None)], 1)]
    got = {}
    for r in chat.canonical_turns(spark.createDataFrame(rows, schema), "id").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {1: [("user", "q"), ("assistant", "a")], 2: [("user", "do"), ("assistant", "done")], 3: [("user", "hi"), ("assistant", "")],
                   4: [("user", "p")], 5: [("user", "q"), ("assistant", "a")], 6: [("user", "")]}


def test_fingerprint_is_the_engine_s(spark):
    sets = [[], ["a"], ["messages[].role", "messages[].content"], ["b", "a", "é"]]
    for s in sets:
        column = F.xxhash64(F.array_join(F.array(*map(F.lit, sorted(s))).cast("array<string>"), "\n"))
        assert spark.range(1).select(column.alias("h")).first().h == chat.fingerprint(s)


def test_registry_decides_for_every_record(spark):
    """All subsets of paths, against the rule by sets; and the registry grows with layouts."""
    fits = chat.layouts_of({"role", "text", "turn", "content", "prompt", "completion", "messages[].role"})
    assert [m.fields for m in fits] == [("role", "text", "turn"), ("completion", "prompt")] and len(chat.registry(fits)) == 2
    names = sorted(p for m in fits for p in m.fields)
    rows = [tuple("x" if n >> i & 1 else None for i in range(len(names))) for n in range(2 ** len(names))]
    own = [F.xxhash64(F.array_join(F.array_compact(F.array(*(F.when(F.col(p).isNotNull(), F.lit(p)) for p in sorted(m.fields)))), "\n")) for m in fits]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    for r in df.withColumn("i", chat.selected(own, fits)).collect():
        there = {n for n in names if r[n]}
        whole = [i for i, m in enumerate(fits) if set(m.fields) <= there]
        some = [i for i, m in enumerate(fits) if set(m.fields) & there]
        assert r.i == (whole or some or [0])[0]


def test_a_table_with_all_layouts(spark):
    schema = "id long, role string, text string, turn int, prompt string, completion string, instruction string, input string, output string, question string, answer string, system string, messages array<struct<role: string, content: string>>, conversations array<struct<`from`: string, value: string>>"
    none = (None,) * 13
    rows = [(1, *none), (2, *none[:9], "why", "so", None, None)[:14], (3, *none[:12], [("human", "q")])]
    got = {(r.conv_id, r.role, r.text) for r in chat.canonical_turns(spark.createDataFrame([(*r, *none)[:14] for r in rows], schema), "id").collect()}
    assert (3, "user", "q") in got and {c for c, _, _ in got} >= {1, 3}


CHAT_EXTRAS = ("formatted", "content", "prompt", "messages", "t", "rows", "_layout", "_conv", "turns", "loss_mask", "p")


def test_chat_nulls_ties_empty(spark):
    schema = "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in CHAT_EXTRAS)
    rows = [(1, None, None, None), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 0, "assistant", "z"), (2, 0, "assistant", "é<s>" * 100_000), (3, 0, "user", "")]
    df = spark.createDataFrame([(*r, *("x",) * len(CHAT_EXTRAS)) for r in rows], schema)
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digest(chat.format_chats(chat.canonical_turns(df, "conv_id"))).collect()}
    assert got == {1: (4, 0), None: (1, 1), 2: (1, 400_000), 3: (1, 0)}
    assert chat.digest(chat.format_chats(chat.canonical_turns(df.limit(0), "conv_id"))).count() == 0


def test_sharding_law(spark):
    docs = table(spark, DATA, "documents")
    got = sharding.op3_sharding(spark, DATA).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    slots = Counter()
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key") and 0 <= r.shard < 16
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard] += 1
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in sorted(slots) for i in range(slots[s])]


def test_sharding_follows_weights_and_moves_little(spark):
    keys = spark.range(20_000).toDF("k")
    heavy = sharding.tree(16, {0: 4.0})
    got = keys.select(sharding.descend(F.col("k"), sharding.tree(16)).alias("a"), sharding.descend(F.col("k"), heavy).alias("b")).toPandas()
    assert abs((got.b == 0).mean() - 4 / 19) < 0.02
    assert (got[got.a != got.b].b == 0).all()  # rows only come into the shard that grew


def test_one_more_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(2_000).toDF("k")
    got = keys.select(*(sharding.descend(F.col("k"), sharding.tree(n)).alias(f"n{n}") for n in range(1, 42))).toPandas()
    for n in range(1, 41):
        old, new = got[f"n{n}"], got[f"n{n + 1}"]
        assert ((old == new) | (new == n)).all() and (new == n).any() and old.nunique() == n
    for n in (1, 5, 17):
        out = sharding.shard_documents(keys.selectExpr("k AS doc_id", "'x' AS text"), shards=n).orderBy("doc_id").toPandas()
        assert (out["shard"] == got[f"n{n}"]).all() and (out.grown_shard == got[f"n{n + 1}"]).all()


def test_sharding_odd_rows(spark):
    df = spark.createDataFrame([(None, None), (None, None), (1, ""), (1, ""), (1, "x" * 100_000)], "doc_id long, text string").selectExpr("*", *(f"99 AS {c}" for c in ("shard", "part", "best", "n", "start", "slot", "size")))
    got = sharding.shard_documents(df).collect()
    assert len(got) == 5 and len({r.shard for r in got if r.doc_id == 1}) == 1
    assert sharding.shard_documents(df.limit(0)).count() == 0


def brute_quality(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(grams)
    cover = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


CASES = [None, "", "a", "a b c d e a b c d e", "Der " * 50, "one two three four five.\n" * 4, "x | y | z | w |\n" * 3, "\n\n \t\x0b", "Fine words stand here, and end well. " * 3, "é" * 50_000, "# # # $ %"]


def test_quality_figures(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)] + [(None, "dup row here", "x")] * 2, "doc_id long, text string, n_words string")
    out = quality.judged(df).collect()
    assert len(out) == len(CASES) + 2
    for r in out:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(CASES[r.doc_id])
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert quality.judged(df.limit(0)).count() == 0


def test_quality_lines_and_columns(spark):
    good = "Many fine words stand in this line, and they end it well."
    text = f"{good}\nOther words stand in a second line, which ends as well.\nHome | About | News | Contact |\n{good[::-1].replace('.', '')}.\nAll rights reserved."
    df = spark.createDataFrame([(1, text, "kept?", 5), (2, "SHOUT!! LOUD!! NOW!! AND!! MORE!! WORDS!! HERE!! TO!! SEE!! IT!! ALL!!", "x", 1)], "doc_id long, text string, kept string, n_chars long")
    got = quality.cleaned(df).collect()
    assert [r.doc_id for r in got] == [1] and got[0].kept == "kept?"
    assert "Home" not in got[0].text and "rights" not in got[0].text and good in got[0].text and got[0].n_chars == len(got[0].text)


def brute_licences(texts: list) -> list[tuple]:
    """Every key phrase at every place, and the share of its template's words around it."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    df = Counter(x for w in split for x in set(w))
    idf = lambda x: round(math.log((1 + len(texts)) / (1 + df[x])) + 1, 6)
    out = []
    for w in split:
        found = []
        for t in licences.TEMPLATES:
            body, key, start = licences.places(t)
            for i in range(len(w) - len(key) + 1):
                if w[i : i + len(key)] == key:
                    at = [i - start + k for k in range(len(body))]
                    met = sum(idf(x) for x, j in zip(body, at) if 0 <= j < len(w) and w[j] == x)
                    found.append((t.label, t.base, i, met / sum(map(idf, body))))
        base = [f for f in found if f[1]]
        first, last = (min(f[2] for f in base), max(f[2] for f in base)) if base else (None, None)
        labels = [",".join(sorted({f[0] for f in group})) for group in (base, found)]
        out.append((len(w), len(base), first, last, *labels, round(max((f[3] for f in found), default=0), 5)))
    return out


def test_licences(spark):
    texts = [None, "", "MIT License", "mit license mit-license", "CC BY CC  BY 4.0", "Licensed under CC BY-NC 4.0.", "xcc by", "GNU GENERAL PUBLIC\nLICENSE, apache\tlicense", "Éapache license", "nothing " * 9000, "Redistribution and use in source and binary forms, with or without modification", "by by cc cc by by license mit mit license license", "license cc by " * 9000]
    texts += [f"x y {t.text} z {t.text[5:]} {t.key}" for t in licences.TEMPLATES] + [t.text.replace(" the ", " a ") for t in licences.TEMPLATES] + ["mit license"] * 3
    extras = ("found", "w", "hits", "n_words", "label", "s", "t")
    rows = [(i, t, *(1,) * len(extras)) for i, t in enumerate(texts)] + [(None, "mit license", *(1,) * len(extras))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in extras))
    want = dict(zip([*range(len(texts)), None], brute_licences([*texts, "mit license"])))
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 5)) for r in licences.scanned(df).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:-1] == w[:-1] and abs(got[i][-1] - w[-1]) < 1e-4, (i, got[i], w)
    assert got[5][5] == "cc-by,cc-by-nc" and got[10][5] == "bsd"
    assert licences.scanned(df.limit(0)).count() == 0


def test_digest_is_plain_sha(spark):
    got = chat.op1_chat(spark, DATA).where("conv_id = -7").first()
    said = "".join(f"{r}\n{chat.PLANTED}\n" for r in ("user", "assistant"))
    assert got.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got.loss_chars == len(chat.PLANTED)
