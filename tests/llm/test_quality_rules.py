import re
from collections import Counter

from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD
from tests.oracle_compare import duck
from tillwise.llm import quality_rules as Q
from tillwise.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered))


def test_counts_match_plain_python(spark, docs_of):
    texts = [*ODD, "a b c a b c a b", "a a a a", "# * $\n# * $\n\n \nx|y <z>", "p q r s p q r t u p q"]
    got = Q.apply_rules(docs_of(texts)).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts(text), text


def test_rules_and_base(docs_of):
    good = " ".join(f"the house{i} and garden{i} of mother{i}" for i in range(20))
    bad = {"capitals": good.upper(), "exclamations": good.replace(" ", "! "), "symbols": good.replace(" ", " | "),
           "stop_words": " ".join(f"house{i}" for i in range(80)),
           "duplicate_lines": "\n".join([" ".join(f"the k{i} and r{i}" for i in range(30))] + ["of it"] * 9)}
    rows = Q.apply_rules(docs_of([good, *bad.values(), "the few words"])).orderBy("doc_id").collect()
    assert rows[0].kept and not rows[0].failed_rules
    for row, rule in zip(rows[1:], bad):
        assert rule in row.failed_rules and not row.kept, rule
    assert rows[-1].base_failed and not rows[-1].kept


def test_extra_clashing_columns_and_empty(spark, docs_of):
    docs = docs_of(["one two", None]).selectExpr("*", "1 as n_words", "2 as kept", "3 as _m", "4 as `_w`", "5 as `a.b`")
    out = Q.apply_rules(docs)
    assert out.columns.count("n_words") == 1 and out.orderBy("doc_id").first().n_words == 2
    assert out.first()["_m"] == 3 and out.first()["a.b"] == 5
    assert Q.keep_good(docs).columns == docs.columns
    assert Q.apply_rules(docs.limit(0)).count() == 0


def test_query_equals_oracle(spark):
    query, sql = queries.QUERIES["op1_quality_rules"]
    got = query(spark, SF_SMALL)
    want = duck(SF_SMALL).sql(sql)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_plan_has_no_shuffle_and_no_python(spark, docs_of):
    plan = Q.apply_rules(docs_of(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_languages_without_a_list(spark):
    ru = " ".join(f"дом{i} и сад{i} стоят у реки" for i in range(20))
    el = " ".join(f"το σπίτι{i} και ο κήπος{i} είναι εδώ" for i in range(20))
    hi = " ".join(f"यह घर{i} और बगीचा{i} नदी{i} के पास है" for i in range(20))
    bare = " ".join(f"house{i}" for i in range(80))
    rows = [(ru, "ru"), (el, "el-GR"), (hi, "hin"), (bare, "en"), (bare, " EN-us"), (bare, "deu"), (bare, "enm"),
            (ru, None), (ru, ""), (ru + "! # " * 200, "ru")]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id bigint, text string, lang string")
    kept = [True, True, True, False, False, False, True, True, True, False]
    judged = Q.apply_rules(docs).orderBy("doc_id").collect()
    assert [r.kept for r in judged] == kept and all(r.failed_rules == ["stop_words"] for r in judged[3:6])
    assert sorted(r.doc_id for r in Q.keep_good(docs).collect()) == [i for i, k in enumerate(kept) if k]
    # no language column: as of a listed language
    assert [r.kept for r in Q.apply_rules(docs.drop("lang")).orderBy("doc_id").collect()[:3]] == [False] * 3
