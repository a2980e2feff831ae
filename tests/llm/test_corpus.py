"""The corpus operators against brute force, on a table of awkward rows and on the given small tables."""

import base64
import collections
import gzip
import hashlib
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from geostat_spark.llm import bpe, language_id, mixing, ngram_lm, queries, sharding, simhash, suffix_dedup, warc
from geostat_spark.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from geostat_spark.llm.quality_rules import host_quality, host_verdicts, measures
from geostat_spark.llm.text import LOWERED, words_in

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, fp long, size long, _id string, _row int, words string"


def prose(seed, n, vocabulary=200):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé") for _ in range(1 + w % 9)) + str(w) for w in (r.randrange(vocabulary) for _ in range(n)))


def awkward():
    shared, long_ = prose(1, 120), prose(2, 20_000, 5_000)
    texts = [
        None, "", None, "   \n\t", "one", "One", "ONE two", "one TWO", "É é ß", "é É SS", "1 2 3 !!", "x " * 300, "x " * 300,
        shared, shared, shared.upper(), shared + " tail words", "head " + shared, prose(3, 60) + " " + shared + " " + prose(4, 60),
        long_, long_ + " z", "a" * 900, "a" * 400, "b" * 399, "ab" * 700, "line one here\nline one here\n\nline two\nline one here",
        "#$% symbols & more | <tags> * #", "a b c d e a b c d e f g h i j k l m n", "<|endoftext|> can't we'll DON'T 123 ümläut́ \x1c　x",
        "tab\x0bvt\x0cff\x85nel\xa0nbsp ls", "🙂 emoji 漢字 かな", "Σίσυφος ΟΔΟΣ", "x <|startoftext|>y<|endoftext|><|endoftext|>",
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], None) for i, t in enumerate(texts)]
    rows += [rows[13], rows[4], (None, shared, "en", None, None), (None, None, None, None, None), (-5, "one", "de", "s1", 3)]
    return [(*r, 1, 2, 3, 4, "x", 5, "y") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return (t or "").translate(LOWERED)


def test_exact_dedup(docs, none):
    groups = collections.defaultdict(list)
    for r in awkward():
        groups[lowered(r[1])].append(r[0])
    got = exact_dedup(docs, digest_all=True).collect()
    assert len(got) == len(awkward())
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    stay = collections.Counter()
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        stay[r["text_sha256"]] += r["kept"]
    assert set(stay.values()) == {1}
    # A sieve of one word lets everything through and must change nothing but the work.
    lazy = exact_dedup(docs, sieve_bits=64)
    assert canonical(lazy.select("doc_id", "keep_id", "group_size").collect()) == canonical(tuple(r)[:3] for r in got)
    assert exact_dedup(none).count() == 0
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(groups) and drop_exact_duplicates(none).count() == 0


def brute_fingerprint(text, k=4):
    words = words_in(lowered(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = root[i], root[j]
                if a != b:
                    root = [a if r == b else r for r in root]
    out = collections.defaultdict(list)
    for i, r in enumerate(root):
        out[r].append(ids[i])
    return [min((x for x in out[r] if x is not None), default=None) for r in root]


def test_simhash(spark, docs, none):
    rows = [(r[0], r[1]) for r in awkward()]
    marks = [brute_fingerprint(t) for _, t in rows]
    lowest = components([i for i, _ in rows], lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 4)
    want = collections.Counter((rows[k][0], f"{marks[k]:016x}", lowest[k]) for k in range(len(rows)))
    got = simhash.simhash_near_dedup(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == want
    assert simhash.simhash_near_dedup(none).count() == 0
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_near_duplicates_go_by_row(spark):
    a, b, c, d = (prose(s, 80) for s in (11, 12, 13, 14))
    # Null ids beside an id, alone and unique; an id with two texts; one id on two equal texts; two texts under two ids.
    rows = [(None, a), (1, a), (None, b), (None, c), (None, c), (5, d), (5, a), (3, prose(15, 80)), (5, prose(15, 80))]
    rows += [(7, prose(16, 80)), (7, prose(16, 80)), (9, d), (8, prose(17, 80)), (7, prose(17, 80))]
    marks = [brute_fingerprint(t) for _, t in rows]
    group = components(list(range(len(rows))), lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 4)
    want = collections.Counter()
    for g in set(group):
        members = [r for r, own in zip(rows, group) if own == g]
        want[min(members, key=lambda r: (r[0] is None, r[0] or 0))] += 1
    assert len(set(group)) == 7 and want[None, b] == want[None, c] == want[5, d] == want[7, prose(17, 80)] == 1
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collections.Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("cap", [20_000, 7])
@pytest.mark.parametrize("max_bits", [3, 4])
def test_links_join_all_that_is_reachable(spark, cap, max_bits):
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(60)}
    for v in list(values)[:30]:
        for _ in range(6):
            for b in r.sample(range(64), r.randrange(1, 6)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    links = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in map(tuple, simhash.fingerprint_links(fps, max_bits, cap).collect())]
    assert all(0 < (a ^ b).bit_count() <= max_bits for a, b in links)
    pairs = set(links)
    want = components(values, lambda i, j: (values[i] ^ values[j]).bit_count() <= max_bits)
    assert components(values, lambda i, j: (values[i], values[j]) in pairs or (values[j], values[i]) in pairs) == want


def test_language_held_out(spark, docs, none):
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    both = both[both.held_out & both.lang.notna() & (both.lang_pred != "und")]
    assert len(both) > 100 and (both.lang == both.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()
    small = language_id.identify_language(docs).select("doc_id", "text", "lang_pred", "score", "_row").collect()
    for r in small:
        letters = r["text"] and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] in ("en", "de")) == bool(letters) and (letters or r["score"] == 0)
    assert len(small) == len(awkward()) and language_id.identify_language(none).count() == 0
    unlabelled = language_id.identify_language(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    assert not any(map(language_id.has_letter, ("", "1 2", "½ ² Ⅷ _", "̈!"))) and all(map(language_id.has_letter, ("1a", "漢", "ʰ")))


def test_temperature():
    r = np.random.default_rng(1)
    scores, true = r.normal(size=(4000, 3)) * 2, 3.0
    p = np.exp(scores / true)
    labels = np.array([r.choice(3, p=row / row.sum()) for row in p])
    assert abs(language_id.calibrate(scores, labels) - true) < 0.6 and language_id.calibrate(np.zeros((0, 3)), np.zeros(0, int)) == 1


def sound(payload, uri="http://a/"):
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [lambda r: r, gzip.compress])
def test_salvage(pack):
    parts = [pack(sound(prose(i, 50).encode())) for i in range(5)]
    whole = b"".join(parts)
    assert [f[2] for f in warc.salvage(whole)] == [None] * 5
    edge = np.cumsum([0, *map(len, parts)])
    bad = bytearray(whole)
    bad[edge[1] + len(parts[1]) // 2] ^= 0xFF
    found = list(warc.salvage(bytes(bad)))
    assert [(f[0], f[1]) for f in found if f[2]] == [(edge[1], len(parts[1]))] and sum(f[2] is None for f in found) == 4
    for text in (b"junk" + whole + b"junk", whole[:-3], b"", b"junk", parts[0][: len(parts[0]) // 2] + b"".join(parts[1:])):
        found = list(warc.salvage(text))
        assert sum(f[1] for f in found) == len(text) and [f[0] for f in found] == sorted(f[0] for f in found)
        assert sum(f[2] is None for f in found) >= min(4, text.count(parts[2]) * 4)


def test_salvage_within_a_member():
    payloads = [base64.b64encode(random.Random(i).randbytes(30_000)) for i in range(5)]
    records = [sound(p) for p in payloads]
    kept = lambda data: [payloads.index(f[4]) if f[2] is None else f[2] for f in warc.salvage(data)]
    # A bad digest, a wrong length and a cut header in the middle of one member.
    for bad in (records[2].replace(payloads[2][:9], b"x" * 9), records[2].replace(b"Length: 4", b"Length: 3"), records[2][:40]):
        packed = gzip.compress(b"".join(records[:2]) + bad + b"".join(records[3:]))
        found = kept(packed)
        assert [f for f in found if isinstance(f, int)] == [0, 1, 3, 4] and len(found) == 5 and isinstance(found[2], str)
        assert kept(packed + gzip.compress(records[2]))[-1] == 2
    whole = gzip.compress(b"".join(records))
    assert kept(whole) == [0, 1, 2, 3, 4]
    # Cut off, and a zlib error: what was unpacked before is read, and a sound member after it.
    assert kept(whole[: len(whole) * 7 // 10]) == [0, 1, 2, "gzip member cut off"]
    broken = bytearray(whole)
    broken[len(whole) * 7 // 10 : len(whole) * 7 // 10 + 2000] = b"\xff" * 2000
    found = kept(bytes(broken) + gzip.compress(records[4]))
    assert found[:2] == [0, 1] and found[-1] == 4 and any(isinstance(f, str) for f in found)
    assert sum({(f[0], f[1]): f[1] for f in warc.salvage(bytes(broken) + b"junk")}.values()) == len(broken) + 4
    # A wrong checksum of the member: records with a digest of their own stay, others are not trusted.
    bare = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    packed = bytearray(gzip.compress(records[0] + bare + records[1]))
    packed[-8] ^= 0xFF
    assert kept(bytes(packed)) == [0, "no digest in a damaged member", 1, "gzip member damaged"]


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_members_are_fed_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    parts = [gzip.compress(sound(prose(i, 30).encode())) for i in range(4)]
    found = list(warc.salvage(b"".join(parts)))
    assert [(f[0], f[1], f[2]) for f in found] == [(sum(map(len, parts[:i])), len(parts[i]), None) for i in range(4)]


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}\r\nx" if i % 2 else None, t) for i, t in enumerate([None, "", "same", "same", "é\r\n\r\nWARC/1.1\r\n", "same", "z" * 50_000])]
    rows += [(2, "twice", "same"), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows) and all(r["fault"] is None for r in got)
    kinds = collections.Counter((r["record_type"], r["refers_to"]) for r in got)
    assert kinds == {("response", None): 6, ("revisit", "<urn:page:2>"): 2, ("revisit", "<urn:page:0>"): 1}
    payloads = {r["record_id"]: bytes(r["payload"]).decode() for r in got if r["payload"] is not None}
    assert payloads["<urn:page:4>"] == rows[4][2] and payloads["<urn:page:6>"] == rows[6][2]
    for r in got:
        if r["record_type"] == "response":
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode()
    warc.write_warc(pages.limit(0), path + "0")
    assert warc.read_warc(spark, path + "0").count() == 0


def test_smallest_capacity():
    r = random.Random(3)
    for _ in range(60):
        sizes = [r.randrange(1, 30) for _ in range(r.randrange(1, 12))]
        k = r.randrange(1, 5)
        best = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
        for _ in range(k - 1):
            best = [min(max(best[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)]
        assert sharding.smallest_capacity(np.array(sizes), k) == best[-1]


def test_cuts_over_spark_equal_cuts_over_all_groups(spark):
    r = random.Random(4)
    groups = sorted((r.getrandbits(64) - 2**63, r.randrange(1, 50) if i else 900) for i in range(400))
    rows = spark.createDataFrame(groups, "order long, size long")
    capacity, cuts = sharding.minimax_cuts(rows, 8, step_bits=3)
    sizes = np.array([s for _, s in groups])
    assert capacity == sharding.smallest_capacity(sizes, 8)
    assert cuts == [groups[e][0] for e in sharding.greedy_ends(sizes, capacity, 8)[:-1] if e < len(groups)]


def test_shards(docs, none):
    got = sharding.shard_documents(docs, rows_per_piece=3).toPandas()
    texts = [r[1] or "" for r in awkward()]
    assert len(got) == len(texts) and collections.Counter(got["size"]) == collections.Counter(len(t.encode()) + 1 for t in texts)
    assert set(got.text_crc32) == {zlib.crc32(t.encode()) for t in texts} and (got.groupby("text_crc32").shard.nunique() == 1).all()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert sharding.shard_documents(none).count() == 0


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_padding(), t.no_truncation()
    return t


def test_bpe(spark, docs, none):
    t = library()
    texts = [r[1] for r in awkward()] + [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    encoder = bpe.Encoder(bpe._definition(queries.tokenizer_path()), remembered=500)
    for text in texts:
        want = t.encode(text or "", add_special_tokens=False).ids
        assert encoder.encode(text) == want
        assert encoder.describe(encoder.split(text))[2] == t.decode(want, skip_special_tokens=False) == encoder.decode(want)
    encoded = bpe.encode(docs, queries.tokenizer_path())
    back = bpe.decode(encoded, queries.tokenizer_path()).collect()
    assert collections.Counter(r["text"] for r in back) == collections.Counter(t.decode(t.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in awkward())
    assert bpe.token_digests(none, queries.tokenizer_path()).count() == 0


def test_few_texts_are_split_up_at_a_time(monkeypatch):
    encoder = bpe.Encoder(bpe._definition(queries.tokenizer_path()))
    texts = [prose(seed, 2_000, 5_000) for seed in range(120)] + [None, ""]
    held, prepare = [], encoder.prepare

    def watched(group):
        held.append(sum(len(chunk) + 1 for text in group for _, chunks in text for chunk in chunks))
        prepare(group)

    monkeypatch.setattr(encoder, "prepare", watched)
    found = bpe._described(encoder, texts, lambda d: d)
    assert sum(held) > 1 << 20 and max(held) <= (1 << 18) + max(len(t or "") for t in texts) + 1_000
    other = bpe.Encoder(encoder.library.to_str())
    other.prepare(split := [other.split(t) for t in texts])
    assert found == [other.describe(t) for t in split]


def test_every_token_can_be_reached():
    encoder = bpe.Encoder(bpe._definition(queries.tokenizer_path()))
    assert encoder.merges.reached == set(encoder.merges.made)


def test_targets(spark):
    r = random.Random(2)
    for sizes in ([10, 1000, 10, 0], [1, 1, 1], [5], [0, 0], [1, 1, 5000, 3, 3, 3000, 2]):
        names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
        got = mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()
        got = {x["source"]: x["target"] for x in got}
        want, full, total = {}, set(), sum(sizes)
        weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
        while True:
            rest = total - sum(3 * s for n, s in zip(names, sizes) if n in full)
            share = sum(weight[n] for n in names if n not in full)
            want = {n: 3.0 * s if n in full else rest * weight[n] / share for n, s in zip(names, sizes)}
            more = {n for n, s in zip(names, sizes) if n not in full and want[n] > 3 * s}
            if not more:
                break
            full |= more
        assert got == pytest.approx(want)
    assert r


def test_flight_keeps_both_totals():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 500):
        sizes, p = r.integers(0, 60, n), np.full(n, 0.37)
        out = mixing.flight(p, sizes, r)
        assert out.sum() == pytest.approx(p.sum()) and (out * sizes).sum() == pytest.approx((p * sizes).sum())
        assert ((out > 0) & (out < 1)).sum() <= 2 and ((0 <= out) & (out <= 1)).all()


def test_landing_is_the_sample_of_least_imbalance():
    r = np.random.default_rng(3)
    assert len(mixing.landing(np.zeros(0), np.zeros(0), r)) == 0
    for n in range(1, 9):
        p, sizes = r.random(n) * 0.98 + 0.01, r.integers(0, 60, n).astype(float)
        every = [np.array(x, float) for x in itertools.product((0, 1), repeat=n)]
        cost = lambda x: abs(x @ sizes - p @ sizes) + max(abs(x.sum() - p.sum()) - 1, 0) * sizes.mean() / 10
        assert cost(mixing.landing(p, sizes, r)) == pytest.approx(min(map(cost, every)))
    drawn = [mixing.landing(np.array([0.5, 0.5]), np.array([7.0, 7.0]), r)[0] for _ in range(2000)]
    assert np.mean(drawn) == pytest.approx(0.5, abs=0.05)


def test_mix(spark, docs, none):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    first = mixing.mix_sources(table, block=5).join(table.select("doc_id", "source"), "doc_id").toPandas()
    again = mixing.mix_sources(table.repartition(7), block=5).select("doc_id", "taken").toPandas()
    assert dict(zip(first.doc_id, first.taken)) == dict(zip(again.doc_id, again.taken))
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    assert all(len(words_in(texts[i])) == s for i, s in zip(first.doc_id, first["size"])) and (first.taken <= 3 * first["size"]).all()
    assert first.taken.sum() == pytest.approx(first["size"].sum(), rel=0.05)
    for _, part in first.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 2 * part["size"].max() + 1e-6
        assert part.source_size.iloc[0] == part["size"].sum()
    whole = mixing.mix_sources(table).join(table.select("doc_id", "source"), "doc_id").toPandas()
    for _, part in whole.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 0.02 * part.target.iloc[0]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixing.mix_sources(docs).count() == len(awkward())
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def brute_repeats(texts, length):
    seen = collections.Counter()
    for t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))[: len(gone)]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,crowd", [(400, 64, 2000), (400, 100, 1), (40, 10, 2000), (40, 10, 2)])
def test_repeats(spark, docs, none, length, gram, crowd, monkeypatch):
    if length == 40:
        monkeypatch.setattr(suffix_dedup, "STRETCH", 333)
    rows = [(r[0], r[1]) for r in awkward()]
    r = random.Random(9)
    base = prose(8, 150)
    for k in range(12):
        cut = r.randrange(len(base))
        rows.append((100 + k, prose(50 + k, 20) + base[:cut] + "EDIT" + base[cut + 3 :] + prose(70 + k, 20)))
    rows = [x for x in rows if len(x[1] or "") < 100_000]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(table, length=length, gram=gram, crowd=crowd, batches=3)
    want = brute_repeats([(t or "").encode() for _, t in rows], length)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((i, *w) for (i, _), w in zip(rows, want))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_family(spark):
    """Levels are sorted arrays of powers of two of batches; scans find every suffix of two batches, with its number."""
    r = random.Random(4)
    parts = [[bytes(r.choices(b"abc", k=4)) for _ in range(r.randrange(40))] for _ in range(7)]
    family = suffix_dedup.SuffixFamily(spark)
    for k, part in enumerate(parts, 1):
        family.add(spark.createDataFrame([(x,) for x in part], "suffix binary"))
        assert [size for size, _ in family.levels] == [1 << b for b in range(3, -1, -1) if k >> b & 1]
    counted = collections.Counter(x for part in parts for x in part)
    held = collections.Counter()
    for _, name in family.levels:
        for row in spark.table(name).collect():
            held[bytes(row["suffix"])] += row["n"]
    assert held == counted
    assert {bytes(x["suffix"]): x["n"] for x in family.matched().collect()} == {x: n for x, n in counted.items() if n > 1}
    names = [name for _, name in family.levels]
    for path in [spark.table(name).inputFiles() for name in names]:
        for file in path:
            got = [bytes(x[0]) for x in spark.read.parquet(file).select("suffix").collect()]
            assert got == sorted(got)
    family.drop()
    assert not any(spark.catalog.tableExists(name) for name in names)


def test_scores(spark, docs, none):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    for settings in (ngram_lm.Settings(), ngram_lm.Settings(hot_words=50, bytes_per_part=10_000)):
        got = {r["doc_id"]: r for r in ngram_lm.score_documents(table, held, settings=settings).collect()}
        texts = {r["doc_id"]: words_in(lowered(r["text"])) + [None] for r in table.collect()}
        counts, pairs = collections.Counter(), collections.Counter()
        for i, tokens in texts.items():
            if zlib.crc32(str(i).encode()) % 5 != 1:
                counts.update(tokens)
                pairs.update(zip([None, *tokens], tokens))
        n, v = sum(counts.values()), len(counts)
        level = lambda c: (2 ** math.floor(math.log2(c) + 1e-9) * 1.5) if c else 0
        gaps = []
        for i, tokens in texts.items():
            r = got[i]
            base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
            assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
            want = 0.0
            for a, b in zip([None, *tokens], tokens):
                context, single = level(counts[a]), (level(counts[b]) + 0.5) / (n + 0.5 * (v + 1))
                want += math.log10((min(level(pairs[a, b]), context) + 5 * single) / (context + 5))
            gaps.append(abs(r["score"] - want) / len(tokens))
        assert np.mean(gaps) < 0.2  # false alarms of the filter only
    assert ngram_lm.score_documents(docs).count() == len(awkward()) and ngram_lm.score_documents(none).count() == 0
    everything = ngram_lm.score_documents(docs, F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in everything)


def test_filter_larger_than_a_broadcast_scores_alike(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(spark.createDataFrame([(None, None, "en", None, 0), (7, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    texts = [(r["doc_id"], r["held"], words_in(lowered(r["text"])) + [None]) for r in table.withColumn("held", held).collect()]
    counts, pairs = collections.Counter(), collections.Counter()
    for _, out, tokens in texts:
        if not out:
            counts.update(tokens)
            pairs.update(zip([None, *tokens], tokens))
    n, v = sum(counts.values()), len(counts)
    level = lambda c: (2 ** math.floor(math.log2(c) + 1e-9) * 1.5) if c else 0
    want = collections.defaultdict(list)
    for i, _, tokens in texts:
        score = 0.0
        for a, b in zip([None, *tokens], tokens):
            context, single = level(counts[a]), (level(counts[b]) + 0.5) / (n + 0.5 * (v + 1))
            score += math.log10((min(level(pairs[a, b]), context) + 5 * single) / (context + 5))
        want[i, len(tokens)].append(score)
    results = []
    # The default is one broadcast; of 20,000 bytes the filter, entries at 8 bits each, needs many slices.
    for most in (256 << 20, 20_000):
        settings = ngram_lm.Settings(most_filter_bytes=most, bytes_per_part=10_000)
        model, _ = ngram_lm.train(table.where(~held).select("text"), settings)
        assert isinstance(model.filter, ngram_lm.Segments) == (most == 20_000)
        got = ngram_lm.score_documents(table, held, settings=settings).collect()
        assert len(got) == len(texts)
        gaps = [min(abs(r["score"] - w) for w in want[r["doc_id"], r["n_tokens"]]) / r["n_tokens"] for r in got if r["held_out"]]
        assert np.mean(gaps) < 0.1  # log10 a token
        results.append(sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got))
    assert np.allclose(np.array(results[0]), np.array(results[1]), rtol=1e-9)


def test_level_filter_has_no_misses():
    r = np.random.default_rng(2)
    grams, counts = np.unique(r.integers(0, 2**63, 5000).astype(np.uint64)), None
    counts = r.integers(1, 5000, len(grams))
    s = ngram_lm.Settings()
    bits = ngram_lm._segment(grams, counts, s, s.bits_per_entry)
    f = ngram_lm.Filter(bits, np.array([len(bits)]), s.probes, 13)
    assert (f.level_of(grams) >= ngram_lm.levels(counts, s.base)).all()
    assert (f.level_of(r.integers(0, 2**63, 5000).astype(np.uint64)) > 0).mean() < 0.1


def canonical(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("where", ["awkward", DATA])
def test_sql(spark, tmp_path, name, where):
    if where == "awkward":
        where = str(tmp_path)
        rows = [r for k, r in enumerate(awkward()) if r[0] is not None and k < 33]
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
        pages = [(r[0], None, r[1]) for r in rows]
        spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
        turns = [(r[0] % 5, k, r[3], r[1]) for k, r in enumerate(rows)]
        spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
        files = "/*.parquet"
    else:
        files = ""
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}/{t}.parquet{files}')")
    got = queries.QUERIES[name](spark, where)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert canonical(got.collect()) == canonical(want)


def test_hosts(spark, docs, none):
    rows = [(i, "bad words " * 20 if h == "bad" else prose(i, 40), h) for i, h in enumerate(["bad"] * 60 + ["good"] * 60 + ["tiny"])]
    rows.append((999, prose(999, 40), "bad"))
    rows.append((1000, "too short", "tiny"))
    got = {r["doc_id"]: r for r in host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[999]["base_failed"] and got[999]["host_rejected"] and not got[999]["kept"]
    assert all(got[i]["kept"] for i in range(60, 121)) and not got[1000]["kept"] and not got[1000]["host_rejected"]
    assert host_quality(docs).count() == len(awkward()) and host_quality(none).count() == 0
    assert host_verdicts(measures(docs)).count() == 3


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "tokens"]
    _, language, exact, near, mix, tokens = None, *[f for _, f in corpus_pipeline.STAGES]
    spoken = language(spark, docs, DATA)
    assert spoken.columns == docs.columns and 0.8 * docs.count() < spoken.count() <= docs.count()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    best = {}
    for i, t in rows:
        best[lowered(t)] = max(best.get(lowered(t), i), i)
    left = exact(spark, docs, DATA)
    assert {r["doc_id"] for r in left.collect()} == set(best.values())
    marks = [brute_fingerprint(t) for _, t in rows]
    lowest = components([i for i, _ in rows], lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 4)
    assert {r["doc_id"] for r in near(spark, docs, DATA).collect()} == set(lowest)
    assert mix(spark, docs, DATA).columns == docs.columns
    assert tokens(spark, docs, DATA).count() == docs.count()
    assert entry.queries()["pipeline"](spark, DATA).count() > 0


def test_language_stage_rejects_texts_without_letters_only(spark, monkeypatch):
    spoken = lambda t: bool(t) and language_id.has_letter(t)
    # Few words around numbers, in texts of many languages, are doubtful; they have a language all the same.
    rows = [(i, prose(i, 1 + i % 3), f"l{i % 9}") for i in range(90)] + [(100 + i, t, "l1") for i, t in enumerate((None, "", " ", "1 2", "½ _", "1a"))]
    rows += [(None, "words", None), (None, "12", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter(r for r in rows if spoken(r[1]))
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, DATA).count() == len(rows)
    monkeypatch.setattr(corpus_pipeline, "UNWANTED", tuple(f"l{k}" for k in range(9)))
    assert corpus_pipeline.language(spark, docs, DATA).count() == 0


def test_bench_names_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
