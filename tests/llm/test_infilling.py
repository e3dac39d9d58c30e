"""Fill-in-middle against its definition in Python."""

import hashlib

import pytest
from conftest import DATA

from tessera.llm import infilling
from tessera.llm.common import table


def by_hand(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out, a, m = "plain", t, None, None
    else:
        p, m, s = t[:a], t[a:b], t[b:]
        form = "spm" if h4 % 100 < 20 else "psm"
        out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
        m = len(m)
    return (doc_id, n, form, a, m, out, t)


ODD = [None, "", "é", "á \U0001f468‍\U0001f469 日本\n\r\t\x00end", "x <P> y", "<S>", "..<M>", "<", "<P", "P>S>M>", "<<P", "> <", "same", "same", "x" * 70_000, "日" * 40_000]


@pytest.mark.parametrize("most", [infilling.RUN_BYTES, 1])
def test_infilling(spark, most):
    docs = [(i, t) for i, t in enumerate(ODD * 8)] + [(None, "no id"), (None, None), (5, "again"), (5, "again"), (-3, "below"), (2**62, "far")]
    docs += [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    df = spark.createDataFrame([(t, i, "c", 1) for i, t in docs], "text string, doc_id long, batch string, u int").repartition(3)
    made = infilling.transformed(df, most=most)
    want = [by_hand(*d) for d in docs]
    got = [tuple(r)[:6] for r in made.collect()]
    assert sorted(got, key=repr) == sorted((w[:6] for w in want), key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    back = [(r.doc_id, r.n, r.text, r.output_sha256, r.restored_sha256) for r in infilling.restored(made, most).collect()]
    assert sorted(back, key=repr) == sorted(((w[0], w[1], w[6], sha(w[5]), sha(w[6])) for w in want), key=repr)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}


def test_none(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert infilling.restored(infilling.transformed(none)).count() == 0


def test_same_as_sql(spark, agree):
    agree(infilling.op12_infilling, infilling.ORACLE_OP12)
