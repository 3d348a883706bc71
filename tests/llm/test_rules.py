from quire.llm import rules
from tests.oracle import compare


def test_against_sql(spark):
    assert compare(spark, "/root/testdata/sf0.01", rules.op10_rules, rules.OP10_SQL) == 1000


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def test_cases_against_brute_force(spark):
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a a", "x y z\nx y z\n\nx y z ",
             "w " * 30000, "é # ü | <>\x0b\x0cß", "one two\x1cthree   four", "\n\n\na\na\r\na\r"]
    docs = spark.createDataFrame([(i, t, 1, True) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept boolean")
    docs = docs.union(docs.limit(3))
    for r in rules.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert rules.judge(docs.limit(0)).count() == 0


def test_plan_has_no_user_function(spark, folder):
    plan = rules.op10_rules(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_good_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = rules.op10_rules(spark, folder).where("not base_failed").join(labels, "doc_id")
    counts = {(r.quality, r.kept): r.n for r in rows.groupBy("quality", "kept").count().withColumnRenamed("count", "n").collect()}
    assert counts.get((1, False), 0) == 0
