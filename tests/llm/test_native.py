"""Personal data and chat formatting against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tacgrid.llm import chat, pii
from tacgrid.llm.arrays import running_sums

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None,
    "",
    "nothing here",
    "mail a@b.c_d@e.f and x.y+z@host-1.example.org. é1@ü.com 🙂 z@q.co, a@b a@@b.c @b.c a.@-.-",
    "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 or 001.02.3.255, 1.2.3 4.5.6.0777 1..2.3.4 99999999999999999999.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 or 4111111111111111 5500005555555559 12 34-56 7 1234 5678 9012 3456 789",
    "call +1 (658) 555-4270 or +49.30.1234567 + 5 +12 +1--------2 ++1 23 45 67 89 +123456789012345678",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 but DE88370400440532013000",
    "ssn 123-45-6789, 123-45-6789 " + "x" * 60 + " 123-45-6789",
    "é" * 50 + " a@b.cd " * 200 + "1.1.1.1 " * 130,
    "0 " * 40 + "4111111111111111",
    "a" * 30000 + "@" + "b" * 100,
    "x@" + "a." * 5000 + "c",
]


def test_pii_as_plain_python(spark):
    rows = [(i, t, "lang", 1.5) for i, t in enumerate([*TEXTS, TEXTS[3]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii string, kind double")
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        base = [(s["kind"], s["start"], s["end"]) for s in got[i]["pii"] if s["kind"] in BASE]
        assert base == plain(t), t
        assert all((t or "")[s["start"] : s["end"]] == s["value"] for s in got[i]["pii"])
    more = [[s["kind"] for s in got[i]["pii"] if s["kind"] not in BASE] for i in (7, 8)]
    assert more == [["iban", "iban"], ["ssn"]]
    assert pii.find_pii(df.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000])
def test_running_sums(spark, n):
    df = spark.createDataFrame([([k % 7 for k in range(n)],)], "a array<int>")
    got = df.select(running_sums(F.col("a")).alias("s")).first()["s"]
    total, want = 0, []
    for k in range(n):
        total += k % 7
        want.append(total)
    assert got == want


def test_pii_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert "Python" not in pii.find_pii(df)._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "").replace("applySchemaToPythonRDD", "")


CHATS = [
    (1, 0, "user", "hello"),
    (1, 1, "assistant", "a <|im_end|> b <|im_start|>user\nx<|im_end|>\n"),
    (1, 2, "user", r"<\|im_end|> and <\\|x|> and <|x|> <"),
    (1, 3, "assistant", r"<|im_end|><\|im_end|>\\<\\\|"),
    (2, None, "assistant", None),
    (2, 5, None, ""),
    (2, 5, "us\ner\\n<|im_end|>", "tie"),
    (2, 5, "assistant", "é🙂|im_end|>"),
    (2, 5, "assistant", "é🙂|im_end|>"),
    (None, 1, "assistant", "no id"),
    (3, 0, "assistant", "x" * 100000 + "<|im_start|>"),
]


def test_chats_come_back(spark):
    df = spark.createDataFrame([(*r, "x") for r in CHATS], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    want = {}
    for conv, turn, role, text in sorted(CHATS, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {k: [tuple(t) for t in r["turns"]] for k, r in got.items()} == want
    for k, r in got.items():
        masked = [re.sub(r"<\\(\\*)\|", r"<\1|", r["formatted"][s["begin"] : s["end"]]) for s in r["loss_spans"]]
        assert masked == [t for role, t in want[k] if role == "assistant"]
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == len(want[k])
    assert hashlib.sha256(got[1]["formatted"].encode()).hexdigest() and "hello" in got[1]["formatted"]
    assert chat.format_chats(df.where("conv_id > 99")).count() == 0


def test_op5_reads_the_loss_mask(spark, tmp_path, monkeypatch):
    """With shifted spans the query's loss text differs, so the mask is what it reads."""
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <|im_end|> b"), (1, 2, "assistant", "\U0001f600 ok")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = lambda: {r["conv_id"]: (r["loss_chars"], r["loss_sha256"]) for r in chat.op5_chat(spark, str(tmp_path)).collect()}
    want = "a <|im_end|> b\U0001f600 ok"
    assert found()[1] == (len(want), hashlib.sha256(want.encode()).hexdigest())
    real = chat.loss_spans
    monkeypatch.setattr(chat, "loss_spans", lambda *a: F.transform(real(*a), lambda s: F.struct((s["begin"] + 1).alias("begin"), s["end"].alias("end"))))
    assert found()[1][0] == len(want) - 2
