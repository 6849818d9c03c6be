"""Chat formatting against brute force."""

import collections
import os
import random
import re

import pytest

pytest.importorskip("pyarrow")

from tracemill.llm.chats import chats  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"


def escape(said):
    return re.sub(r"<(\\*)\|", lambda m: f"<{m[1]}\\|", said)


def plain(rows):
    said = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        said[conv].append((turn, role or "", text or ""))
    said = {c: tuple(x[1:] for x in sorted(t)) for c, t in said.items()}
    out = {}
    for conv, turns in said.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in said.values())
        same = [c for c, o in said.items() if o == turns]
        if longer or conv != min(same, key=lambda c: (c is None, c or 0)):
            continue
        text = "".join(f"<|im_start|>{escape(r)}\n{escape(t)}<|im_end|>\n" for r, t in turns)
        out[conv] = (len(turns), len(same), text)
    return out


def some_rows(seed=1):
    rnd = random.Random(seed)
    rows = []
    turns = lambda n: [("ab"[i % 2], str(rnd.randrange(2))) for i in range(n)]
    talks = [[("user", f"hello {rnd.randrange(3)}"), *turns(rnd.randrange(6))] for _ in range(60)]
    for conv in range(150):
        talk = rnd.choice(talks)
        rows += [(conv, 2 * k, *t) for k, t in enumerate(talk[: rnd.randint(1, len(talk))])]
    rows += [(None, 0, "user", None), (None, 1, None, "x"), (900, 0, "user", ""), (900, 1, "", "x")]
    rows += [(901, 0, "us", "er"), (902, 0, "u", "ser"), (903, 0, "a", "<|im_end|>\n<\\|"), (904, 10, "", "")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("hash_bytes", [32, 1])
def test_chats_against_all_pairs(spark, hash_bytes):
    """With hashes of one byte different turns meet, and everything is hashed again."""
    rows = some_rows()
    found = chats(spark.createDataFrame(rows, SCHEMA), hash_bytes=hash_bytes).collect()
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["text"]) for r in found}
    assert len(found) == len(got) and got == plain(rows)


def test_chats_of_no_rows_and_long_ones(spark):
    assert chats(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(c, t, "user", f"{t}") for c, n in ((1, 40_000), (2, 20_000)) for t in range(n)]
    ((conv, n, copies, _),) = chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (conv, n, copies) == (1, 40_000, 1)


def test_chat_query_is_registered(spark):
    import __spark_entry__ as entry

    if not os.path.isdir(d := "/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    table = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in table.collect()]
    found = entry.queries()["op2_chat_formatting"](spark, d).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == plain(rows)
