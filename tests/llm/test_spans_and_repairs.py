"""Substring dedup, conversation repair and periodic runs against brute force and SQL."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from test_corpus import DATA, SCHEMA, awkward, canonical, prose

from geostat_spark.llm import conversation_repair, periodic_runs, queries, substring_dedup, word_arrays
from geostat_spark.llm.text import words_in


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward() + more(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def more():
    """Passages at all distances from the start, in several documents and twice in one, at a text's ends."""
    passage, other, r = prose(31, 61), prose(32, 50), random.Random(7)
    texts = [f"{prose(40 + k, r.randrange(40))} {passage} {prose(60 + k, r.randrange(40))}" for k in range(12)]
    texts += [other, other, f"{other} {other}", f"x {other}", " ".join(other.split()[:49]), f"{passage} {passage}", "loop " * 130 + passage]
    return [(200 - i, t, "en", "s", None, 1, 2, 3, 4, "x", 5, "y") for i, t in enumerate(texts)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_passages(rows, length):
    least = {}
    order = lambda i: (i is None, i or 0)
    texts = [(i, words_in(t or "")) for i, t in rows]
    for i, ws in texts:
        for p in range(len(ws) - length + 1):
            gram = tuple(ws[p : p + length])
            least[gram] = min(least.get(gram, (2, 0)), order(i))
    out = []
    for i, ws in texts:
        gone = [False] * len(ws)
        for p in range(len(ws) - length + 1):
            if least[tuple(ws[p : p + length])] < order(i):
                gone[p : p + length] = [True] * length
        kept = [w for w, g in zip(ws, gone) if not g]
        out.append((i, len(ws), len(ws) - len(kept), sha(" ".join(kept))))
    return out


@pytest.mark.parametrize("length", [3, 10, 50])
def test_earlier_passages(docs, none, length):
    rows = [r[:2] for r in awkward() + more()]
    got = substring_dedup.remove_earlier_passages(docs, length=length, with_text=True)
    found = [tuple(r) for r in got.collect()]
    assert canonical(r[:4] for r in found) == canonical(brute_passages(rows, length))
    assert all(sha(r[4]) == r[3] for r in found)
    assert substring_dedup.remove_earlier_passages(none).count() == 0


def test_covers_hold_every_distance():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert substring_dedup.cover_for(50)[0] == 31
    with pytest.raises(ValueError):
        substring_dedup.cover_for(2)


def test_anchors_do_not_depend_on_stretches(monkeypatch):
    hashes = np.random.default_rng(3).integers(0, 1 << 60, 1_000).astype(np.uint64)
    whole = [np.concatenate(c) for c in zip(*substring_dedup._anchor_arrays(hashes, 50))]
    monkeypatch.setattr(substring_dedup, "STRETCH", 70)
    parts = [np.concatenate(c) for c in zip(*substring_dedup._anchor_arrays(hashes, 50))]
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0]) > 150


def test_anchors_of_many_documents_are_those_of_each():
    """Texts are hashed together, so that a short text costs no round of array calls of its own."""
    r = np.random.default_rng(4)
    many = [r.integers(0, 1 << 60, n).astype(np.uint64) for n in (0, 49, 50, 1, 51, 400, 0, 73, 1_000)]
    which, *got = substring_dedup._anchors_of_many(many, 50, True)
    each = [(i, *arrays) for i, h in enumerate(many) for arrays in substring_dedup._anchor_arrays(h, 50)]
    assert (which == np.concatenate([np.full(len(e[1]), e[0]) for e in each])).all() and len(which) > 250
    assert all((g == np.concatenate(e)).all() for g, e in zip(got, list(zip(*each))[1:]))
    assert len(substring_dedup._anchors_of_many(many[:2], 50, False)[0]) == 0


def test_word_pieces(monkeypatch):
    data = ("é ab\x0bc  \t" * 500 + "x" * 300).encode()
    monkeypatch.setattr(word_arrays, "PIECE", 17)
    pieces = list(word_arrays.word_pieces(data))
    assert len(pieces) > 100 and list(itertools.chain(*pieces)) == data.split()


def brute_runs(x, least=24):
    out = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in out.items())


def periodic(seed):
    r = random.Random(seed)
    n, k = r.randrange(300), r.choice([2, 3, 5, 50])
    x = [r.randrange(k) for _ in range(n)]
    for _ in range(r.randrange(4)):
        p, a = r.randrange(1, max(2, n // 3)), r.randrange(max(n, 1))
        word = []
        while len(word) < p:  # highly periodic stretches within the period
            word += [r.randrange(k)] * r.randrange(1, 12) if r.random() < 0.6 else [r.randrange(k) for _ in range(3)] * r.randrange(1, 6)
        for i in range(r.randrange(p, 6 * p + 1)):
            if a + i < n:
                x[a + i] = word[i % p]
    return x


@pytest.mark.parametrize("least", [24, 4])
def test_runs(least):
    total = 0
    for seed in range(150):
        x = periodic(seed)
        want = [r for r in brute_runs(x, least)]
        assert periodic_runs.find_runs(np.array(x, np.int64), len(x), least) == want, seed
        total += len(want)
    assert total > 30


def brute_collapse(i, ws):
    runs = brute_runs(ws)
    gone = {k for a, b, q in runs for k in range(a + q, b)}
    best = min(runs, key=lambda r: (-((r[1] - r[0]) / r[2]), r[0], r[2]), default=None)
    shown = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
    return (i, len(runs), *shown, sha(listed), sha(" ".join(w for k, w in enumerate(ws) if k not in gone)))


def test_collapse(spark, docs, none):
    texts = [" ".join(f"w{v}" for v in periodic(seed)) for seed in range(60)]
    rows = [r[:2] for r in awkward() + more() if len(r[1] or "") < 20_000] + [(1_000 + k, t) for k, t in enumerate(texts)]
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert canonical([*r[:1], *r[2:9]] for r in got) == canonical(brute_collapse(i, words_in(t or "")) for i, t in rows)
    assert all(sha(r["collapsed"]) == r["collapsed_sha256"] and len(r["runs"]) == r["n_runs"] for r in got)
    assert periodic_runs.periodic_runs(docs).count() == docs.count() and periodic_runs.periodic_runs(none).count() == 0


def test_planted_runs(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' WHERE length(text) < 6000").fetchall()
    want = []
    for i, t in rows:
        ws, h = words_in(t or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and ws:
            g, n = h // 10, len(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[k] if k < a else ws[a + (k - a) % p] for k in range(n)]
        want.append(brute_collapse(i, ws))
    ids = {i for i, _ in rows}
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, DATA).collect()]
    assert canonical(r for r in got if r[0] in ids) == canonical(want) and len(got) >= len(rows)


CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, part int, whole int"


def conversations(seed=1, n=60, longest=12):
    r, out = random.Random(seed), []
    for c in range(n):
        turn = 0
        for _ in range(r.randrange(longest)):
            turn += r.choice([0, 1, 1, 1, 2])
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            out.append((c, turn if r.random() < 0.95 else None, role, r.choice(["a.", "b?", "c", " ", "", None, "d! \n", "é.", "long text."])))
    return out + [(None, 1, "user", "x."), (None, 2, "assistant", "y."), out[0], out[0]]


def brute_repair(rows):
    """All rows of one conversation in order; plain dynamic programming over (row, state)."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], sha(v[2])))
    seen, faults = set(), []
    for _, r, x in rows:
        ends = x.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not ends else "duplicate" if (r, x) in seen else "truncated" if ends[-1] not in ".!?" else "")
        seen.add((r, x))
    put = lambda s: {"": "u", "s": "u", "a": "u", "u": "a"}[s]
    best = {"": (0, "", ())}
    def closed(found):
        for _ in range(3):
            for s, (c, e, lines) in list(found.items()):
                way = (c + 5, e + "I", (*lines, {"u": "user:", "a": "assistant:"}[put(s)]))
                if put(s) not in found or way < found[put(s)]:
                    found[put(s)] = way
        return found
    best = closed(best)
    for (_, r, x), fault in zip(rows, faults):
        found = {}
        def offer(s, way):
            if s not in found or way < found[s]:
                found[s] = way
        for s, (c, e, lines) in best.items():
            offer(s, (c + 2, e + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                for to in ("s", "u") if s == "" else (put(s),):
                    if r[:1] == to:
                        offer(to, (c + more, e + "K", (*lines, f"{r}:{x}")))
                    if to != "s":
                        offer(to, (c + more + 1, e + "R", (*lines, f"{ {'u': 'user', 'a': 'assistant'}[to]}:{x}")))
        best = closed(found)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(lines)))


@pytest.mark.parametrize("rows_apart", [512, 3])
def test_repair(spark, rows_apart):
    rows = conversations() + conversations(2, 1, 60)
    frame = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], CONVERSATIONS)
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    got = [tuple(r) for r in conversation_repair.repair_conversations(frame, rows_apart=rows_apart).collect()]
    assert canonical(got) == canonical((c, *brute_repair(v)) for c, v in by.items())
    assert conversation_repair.repair_conversations(frame.limit(0)).count() == 0


def test_one_conversation_over_many_pieces(spark):
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["x.", f"t{t}.", f"u{t}", ""])) for t in range(300)]
    frame = spark.createDataFrame([(*v, "k", 1, 2) for v in rows], CONVERSATIONS)
    got = conversation_repair.repair_conversations(frame, rows_apart=17).collect()
    assert [tuple(v) for v in got] == [(7, *brute_repair([v[1:] for v in rows]))]


def test_lightest_derivations_stop_at_the_goal():
    ways = {0: [(1, 3, "b"), (2, 1, "z")], 1: [(3, 1, "a")], 2: [(3, 3, "a")], 3: [(4, 0, "")]}
    done = conversation_repair.lightest([(0, (0, ""))], lambda i: ways.get(i, ()), lambda i: i == 3)
    assert done[3] == (4, "ba") and 4 not in done


@pytest.mark.parametrize("name,table", [("op11_substring_dedup", "documents"), ("op12_conversation_repair", "conversations")])
def test_sql_of_awkward_rows(spark, tmp_path, name, table):
    if table == "documents":
        frame = spark.createDataFrame(awkward() + more(), SCHEMA)
    else:  # damage is told by id and turn, so rows of one turn share it
        frame = spark.createDataFrame([(*r, "k", 1, 2) for r in conversations(3, 120)], CONVERSATIONS)
    frame.write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = queries.QUERIES[name](spark, str(tmp_path))
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert canonical(got.select(*columns).collect()) == canonical(found.fetchall())
