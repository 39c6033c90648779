import hashlib
import random

from poolsieve.llm.chat import BOUNDS, digests, format_conversations

MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]"]


def test_round_trip(spark):
    rng = random.Random(0)
    bits = [*MARKS, "\\", "\\\\", "[", "<", "]", ">", "INST]", "/", "s>", "a", " ", "\n", "é", "😀", "[\\INST]", "<\\\\/s>"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", text(), "tool"]), text()) for c in range(120) for t in range(rng.randrange(1, 7))]
    rows += [(900, 0, None, None), (901, None, "user", "x"), (901, 0, "assistant", "y"), (901, 0, "assistant", "b"), (None, 1, "user", "q"), (902, 1, "user", "same"), (902, 1, "user", "same"), (903, 0, "assistant", "z" * 300_000)]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS formatted").repartition(3)
    out = format_conversations(df)
    got = {r.conv_id: r for r in digests(out).collect()}
    texts = {r.conv_id: r.formatted for r in out.collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert got.keys() == by.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns = [(x[2], x[3]) for x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert tuple(got[c])[1:5] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
        assert got[c].formatted_chars == len(texts[c])
    plain = [(r, t) for r, t in [(x[2], x[3]) for x in sorted(by[902])]]
    assert texts[902] == "".join(f"<s>{BOUNDS[r][0]}{t}{BOUNDS[r][1]}" for r, t in plain)
    assert digests(format_conversations(df.limit(0))).collect() == []
    assert len(set(texts.values())) >= len({str(v) for v in by.values()}) - 1
