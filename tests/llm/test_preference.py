from samples import SF01
from pyspark.sql import functions as F

from almacen.llm import preference, queries
from almacen.llm.common import table

END = "\n<|end|>\n"


def _render(ts):
    out, spans = "", []
    for role, text in ts:
        out += f"<|{role}|>\n"
        start = len(out)
        out += text + END
        if role == "assistant":
            spans.append((start, len(out)))
    return out, spans


def _brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    c, r = _render(chosen[n:]), _render(rejected[n:])
    return n, _render(chosen[:n])[0], c[0], c[1], r[0], r[1]


def _pairs(rows):
    convs = {}
    for i, turn, role, text in rows:
        convs.setdefault(i, set()).add((turn is not None, turn, role or "", text or ""))
    for i, ts in convs.items():
        ts = [(r, t) for _, _, r, t in sorted(ts)]
        at = [k for k, (r, _) in enumerate(ts) if r == "assistant"]
        if not at:
            yield i, ts, ts
            continue
        last = at[-1]
        stale = ts[at[0]][1] if at[0] < last else ts[last - 1][1] if last else ""
        yield i, ts[:last + 1], ts[:last] + [("assistant", stale)]


def _check(df, rows):
    got = {r["pair_id"]: (r["prompt_turns"], r["prompt"], r["chosen"], [tuple(s) for s in r["chosen_spans"]],
                          r["rejected"], [tuple(s) for s in r["rejected_spans"]]) for r in df.collect()}
    assert got == {i: _brute(c, r) for i, c, r in _pairs(rows)}


def test_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (2, 0, "user", None),
            (3, 0, None, "x"), (4, 0, "assistant", "alone"), (5, 0, "system", "s"), (5, 1, "user", "u"),
            (5, 2, "assistant", ""), (5, 3, "user", "ü😀"), (5, 4, "assistant", "é" * 5000), (5, 5, "user", "tail"),
            (None, 0, "user", "n"), (None, 1, "assistant", "m"), (6, None, "user", "first"), (6, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, chosen int")
    _check(preference.format_preferences(preference.stale_answers(df)), rows)


def test_equal_and_diverging_conversations(spark):
    t = [("user", "a"), ("assistant", "b"), ("user", "c")]
    rows = [(1, t, t), (2, t, t[:1]), (3, [], t), (4, [], []), (5, t, [("user", "x"), *t[1:]])]
    df = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, "
                                     "rejected array<struct<role:string,text:string>>")
    got = {r["pair_id"]: r for r in preference.format_preferences(df).collect()}
    for i, c, r in rows:
        want = _brute(c, r)
        assert (got[i]["prompt_turns"], got[i]["prompt"], got[i]["chosen"]) == want[:3] and got[i]["rejected"] == want[4]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.format_preferences(preference.stale_answers(df)).count() == 0


def test_table(spark):
    conv = table(spark, SF01, "conversations")
    rows = [tuple(r) for r in conv.select("conv_id", "turn", "role", "text").collect()]
    _check(preference.format_preferences(preference.stale_answers(conv)), rows)
    assert queries.op6_preference_format(spark, SF01).filter(F.col("prompt_turns") > 0).count() > 0
