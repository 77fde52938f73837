"""Quality rules against a plain Python version, with nulls, empty and long texts, repeats and clashing columns."""

import random
import re

from sparkmend.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    ws = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    runs = {}
    for i in range(len(ws) - 7):
        runs.setdefault(tuple(ws[i:i + 8]), []).append(i)
    hit = {p for at in runs.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit),
            len(ws) < 20 or 100 * len(hit) > 30 * len(ws))


def test_metrics_match_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a", "é ü\x0bß", "one two three four five six seven eight " * 2, "x " * 3000,
             "#*$%&|<> " * 30, "l1\nl1\n \nl1", "  nb sp"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 400))) for _ in range(30)]
    texts += [rng.choice([" ", "\n", "\t"]).join(rng.choice(["the", "of", "w%d" % rng.randint(0, 9)])
                                                 for _ in range(rng.randint(1, 200))) for _ in range(30)]
    rows = [(i // 2, t, 5) for i, t in enumerate(texts)]  # repeated ids, a clashing column name
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = Q.judge(df).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                             "base_failed", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:7] == brute(r.text), r.text
        assert not (r.kept and r.base_failed)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert Q.judge(df).count() == 0


def test_rule_table_is_a_parameter(spark):
    df = spark.createDataFrame([(1, "the cat " * 3 + "unique words follow here " + " ".join(f"w{i}" for i in range(20)))],
                               "doc_id long, text string")
    measured = Q.with_metrics(df)
    assert Q.apply_rules(measured, ()).first().kept
    strict = (Q.Rule("long", "mean_word_length", 50.0, None),)
    r = Q.apply_rules(measured, strict).first()
    assert not r.kept and r.failed_rules == "long"


def test_plan_has_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = Q.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
