"""Sentence spans and the suffix order against SQL and brute force."""

import os
import random

import duckdb
import numpy as np
import pytest

from parchmill.llm import spans, sufdedup
from parchmill.llm.registry import ORACLES, QUERIES
from parchmill.llm.suffix import LOWEST, SuffixOrder

from .conftest import SF, SCHEMA, prose, row


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    answer = con.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    expected = sorted(map(repr, answer.fetchall()))
    assert sorted(repr(tuple(r)) for r in QUERIES[name](spark, SF).select(*columns).collect()) == expected


@pytest.mark.parametrize("small", [False, True])
def test_suffix_order(tmp_path, small):
    rng = np.random.default_rng(1)
    for trial in range(25):
        n = int(rng.integers(1, 25))
        strings = [rng.integers(-2, 3, rng.integers(0, 18)).astype(np.int32) for _ in range(n)]
        if n > 3:
            strings[3] = strings[0].copy()
        order = SuffixOrder(f"file://{tmp_path}", **({"chunk": int(rng.integers(2, 9))} if small else {}))
        cut = int(rng.integers(0, n + 1))  # the strings come in two lots
        for part in (strings[:cut], strings[cut:]):
            order.add(np.concatenate([np.empty(0, np.int32), *part]), np.array([len(s) for s in part]))
        order.build()
        parts = list(order.entries())
        who, lcp, bwt = (np.concatenate([p[c] for p in parts]) for c in ("who", "lcp", "bwt"))
        true = sorted((tuple((x, 0) for x in s[k:].tolist()) + ((-100, i),), i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
        assert [(int(w) >> 8, int(w) & 255) for w in who] == [(i, k) for _, i, k in true]
        assert [int(b) for b in bwt] == [int(strings[i][k - 1]) if k else int(LOWEST) for _, i, k in true]
        common = [0]
        for (a, _, _), (b, _, _) in zip(true, true[1:], strict=False):
            m = 0
            while m < min(len(a), len(b)) - 1 and a[m] == b[m]:
                m += 1
            common.append(m)
        assert lcp.tolist() == common
        for length in (1, 3):
            seen, again = set(), []
            for i, s in enumerate(strings):
                for k in range(len(s) - length + 1):
                    run = tuple(s[k : k + length].tolist())
                    if run in seen:
                        again.append(i << 8 | k)
                    seen.add(run)
            assert order.repeats(length).tolist() == again, trial
        order.close()
    assert not os.listdir(tmp_path)


def brute_runs(rows, run):
    """Cleaned text by id and text, keeping the first occurrence of every run of words."""
    seen, out = set(), {}
    distinct = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0, spans_key(x[1])))
    for i, t in distinct:
        lines = [line.split() for line in t.encode().split(b"\n")]
        words = [w for line in lines for w in line]
        gone = [False] * len(words)
        for k in range(len(words) - run + 1):
            body = tuple(words[k : k + run])
            if body in seen:
                gone[k : k + run] = [True] * run
            seen.add(body)
        left, at = [], 0
        for line in lines:
            kept = [w for w, g in zip(line, gone[at : at + len(line)], strict=True) if not g]
            at += len(line)
            if kept:
                left.append(b" ".join(kept))
        out[(i, t)] = (sum(gone), t if not any(gone) else b"\n".join(left).decode())
    return out


def spans_key(text):
    return 0


def passages(seed):
    rng = random.Random(seed)
    shared = [prose(100 + k, rng.randint(45, 130)) for k in range(6)]
    rows = []
    for i in range(120):
        parts = [prose(1000 * seed + i, rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        rows.append((i, rng.choice(["\n", " ", "\n\n"]).join(parts)))
    rows += [(200, "same " * 400), (201, "same " * 130 + "end"), (202, rows[3][1]), (203, "a b " * 200)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_against_brute_force(spark, seed):
    rows = passages(seed)
    want = brute_runs(rows, sufdedup.RUN)
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in sufdedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: v for (i, _), v in want.items()}
    assert sum(n for n, _ in got.values()) > 1000


def test_odd_rows(spark, odd, none, odd_rows):
    for dedup in (sufdedup.dedup, spans.dedup):
        rows = dedup(odd).collect()
        assert len(rows) == len(odd_rows)
        by = {}
        for r in rows:
            by.setdefault(r["doc_id"], []).append((r["n_removed"], r["text"]))
        assert by[2] == [(0, None)] and by[3] == [(0, "")] and by[4] == [(0, " \n\t ")] and by[9] == [(0, odd_rows[11][1])]
        assert by[5] == [(0, odd_rows[4][1])]  # long, nothing repeats
        texts = [t for _, t in by[None]]
        assert odd_rows[0][1] in texts and texts.count(None) == 2  # a null id comes first, so its copy stays
        assert by[1][0][0] > 0 and by[1][0][1] == "" and by[6] == [by[1][0]] * 2
        assert 0 < len(by[12][0][1]) < 400 if dedup is sufdedup.dedup else by[12][0][0] > 0
        assert dedup(none).count() == 0


def test_long_sentence_and_short_ones(spark):
    """A passage that is one long sentence is caught; a few equal short sentences are not."""
    passage = " ".join(f"w{k}" for k in range(60)) + "."
    rows = [row(1, prose(1, 50) + "\n" + passage), row(2, prose(2, 50) + "\n" + passage + "\n" + prose(3, 30)), row(3, "Er. Of. Er.\n" + prose(4, 30)), row(4, "Er. Of. Er.\n" + prose(5, 30))]
    got = {r["doc_id"]: r for r in spans.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["n_removed"] == 0 and "w3 " not in got[2]["text"] and got[2]["n_removed"] == 5
    assert got[3]["n_removed"] == got[4]["n_removed"] == 0
