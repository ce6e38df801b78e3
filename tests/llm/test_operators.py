"""The training-data operators against brute force, on small tables with awkward rows."""

import base64
import hashlib
import itertools
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from textloom.llm import common, decontaminate, packing, pitman_yor, quality, secrets, simhash, simhash_groups, token_counts, topk, urls, warc
from textloom.llm.components import connected_components
from textloom.llm.token_ids import TokenIds, default_vocabulary

WORDS = "alpha beta gamma delta river stone cloud maple window lantern copper violet harbor meadow signal".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


LONG = prose(60_000, 1)
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "no id here"), (4, "Same text"), (4, "Same text"), (5, LONG), (6, "x" * 30_000),
    (7, "two  spaces\n\nand é ß 日本 😀 <|endoftext|> it's we'll 'S"), (8, "tail \n"), (9, "\x00 a, b. ., c"), (10, "a" * 5),
]


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


# 10, and the ids that packing uses


def test_transducer_counts_equal_the_library(spark, awkward, nothing):
    want = sorted((i or -1, len((t or "").encode()), len(x), len(x) > 1024) for (i, t), x in zip(AWKWARD, ids_of([t for _, t in AWKWARD])))
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(awkward).collect())
    assert got == want
    assert token_counts.count_tokens(nothing).count() == 0


def test_transducer_on_random_strings():
    rng = random.Random(3)
    bits = ["a", "the", "'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "é", "1", "23", ".", "!!", "\xa0", "　", "😀", "日本", "ing", "<|endoftext|>", "\r\n", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(800)] + ["a" * 2000, " " * 1500 + "x", "the" * 900]
    counter = token_counts.TokenCounter()
    assert counter([t.encode() for t in texts]).tolist() == [len(x) for x in ids_of(texts)]


@pytest.mark.parametrize("chunk", [4, 16, 512])
def test_maps_of_chunks_without_a_start_compose(monkeypatch, chunk):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    rng = random.Random(13)
    run = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = [run(3000, "abcdefghij"), "x" * 2500 + " y", run(900, "ab") + "  " + run(700, "e"), "0123456789" * 300, run(2000, "éßñ"), "a b " + run(1500, "ing")]
    got = token_counts.TokenCounter()([t.encode() for t in texts])
    assert got.tolist() == [len(x) for x in ids_of(texts)]


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    with open(default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        token_counts.TokenCounter(str(tmp_path / "v.json"))


def test_transducer_survives_small_tables(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "BLOCK", 1000)
    texts = [prose(400, s) for s in range(4)]
    assert token_counts.TokenCounter()([t.encode() for t in texts]).tolist() == [len(x) for x in ids_of(texts)]


def test_token_ids_equal_the_library(monkeypatch):
    monkeypatch.setattr("textloom.llm.token_ids.MAX_UNITS", 40)
    encode = TokenIds()
    texts = [t or "" for _, t in AWKWARD] + ["a, b. c.\nd, e", "say \"x\", 5, we'll, no._, x ,y"]
    for text, want in zip(texts, ids_of(texts)):
        assert np.frombuffer(encode(text), "<u4").tolist() == want


# 3


def test_packing_round_trip(spark, awkward, nothing):
    rows = packing.pack(awkward, window=256, max_open=4).collect()
    want = {}
    for (i, t), x in zip(AWKWARD, ids_of([t for _, t in AWKWARD])):
        want.setdefault(i, []).append([*x, 1])
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, texts in want.items():
        ids, copies = texts[0], len(texts)
        covered = Counter()
        for r in pieces[i]:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(ids) and r.length > 0
            covered.update(range(r.start, r.start + r.length))
        assert covered == Counter({k: copies for k in range(len(ids))})
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0  # no padding
    assert packing.pack(nothing).count() == 0


def test_sum_of_squares_choice():
    p = packing.Packer(10, 100, 0)
    p.add(1, b"\0\0\0\0" * 6)  # opens a window at level 6
    p.add(2, b"\0\0\0\0" * 6)  # no room: opens another
    assert p.counts[6] == 2
    p.add(3, b"\0\0\0\0" * 4)  # closing one lowers the sum of squares most
    assert p.counts[6] == 1 and p.sequence == 1


def test_placement_by_brute_force():
    rng, w = random.Random(5), 12
    p = packing.Packer(w, 10**6, 0)
    for k in range(400):
        r = rng.randint(1, w)
        before = p.counts.copy()

        def total(level):
            after = before.copy()
            if level:
                after[level] -= 1
            if level + r < w:
                after[level + r] += 1
            return int((after**2).sum())

        choices = [h for h in range(w - r + 1) if h == 0 or before[h]]
        least = min(map(total, choices))
        p.add(k, b"\0\0\0\0" * r)
        assert int((p.counts**2).sum()) == least
        assert sum(len(v) for v in p.open.values()) == p.counts.sum()


def test_windows_are_filled_up_one_at_a_time():
    rng, p = random.Random(6), packing.Packer(100, 5, 0)
    sizes = [rng.randint(1, 70) for _ in range(300)]
    for k, n in enumerate(sizes):
        p.add(k, bytes(4 * n))
        assert p.counts.sum() <= 5 and all(sum(len(x[2]) // 4 for x in ps) == h for h, v in p.open.items() for ps in v)
    p.join_open()
    held, got = defaultdict(int), defaultdict(list)
    for _, _, n, _, _, sequence, _ in p.rows:
        held[sequence] += n
    assert all(n == 100 or n & (n - 1) == 0 for n in held.values()) and sum(held.values()) == sum(sizes)
    for doc, start, n, *_ in p.rows:
        got[doc] += range(start, start + n)
    assert all(sorted(got[k]) == list(range(n)) for k, n in enumerate(sizes))


# 2


def der(tag, body):
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")) + body


def rsa_key():
    numbers = [b"\x00"] + [bytes([1 + k]) * 24 for k in range(8)]
    return der(0x30, b"".join(der(2, x) for x in numbers))


def jwt(head):
    enc = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return ".".join((enc(json.dumps(head).encode()), enc(b'{"sub":1}'), enc(b"signature-bytes")))


def test_structural_confirmation():
    key = rsa_key()
    good = [base64.b64encode(key).decode(), key.hex(), jwt({"alg": "HS256", "typ": "JWT"})]
    broken = [base64.b64encode(key[:-1]).decode(), key[:-1].hex(), jwt({"typ": "JWT"})]
    assert [k for _, k, _ in secrets.find_spans(f"x {good[0]} y")] == [5]
    assert [k for _, k, _ in secrets.find_spans(f"x {good[1]} y")] == [2, 6]
    assert [k for _, k, _ in secrets.find_spans(f"x {good[2]} y")] == [4]
    for text in broken:
        assert all(k < 3 for _, k, _ in secrets.find_spans(f"x {text} y"))
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(good[0][i : i + 64] for i in range(0, len(good[0]), 64)) + "\n-----END RSA PRIVATE KEY-----"
    assert 3 in [k for _, k, _ in secrets.find_spans(pem)]
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"pub") + field(b"blob")
    assert secrets.is_openssh_key(ssh) and not secrets.is_openssh_key(ssh + b"x")


def test_pem_with_headers_and_escapes():
    key = bytes.fromhex("302e020100300506032b657004220420") + bytes(range(32))  # PKCS#8, Ed25519
    body = base64.b64encode(key).decode()
    plain = f"-----BEGIN PRIVATE KEY-----\n{body[:40]}\n{body[40:]}\n-----END PRIVATE KEY-----\n"
    sealed = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n" + base64.b64encode(bytes(range(90))).decode() + "\n-----END RSA PRIVATE KEY-----"
    for text in (plain, sealed, json.dumps({"private_key": plain})):
        assert 3 in [k for _, k, _ in secrets.find_spans(text)] and "[SECRET]" in secrets.redact(text) and body[:20] not in secrets.redact(text)
    for text in (sealed.replace("Proc-Type: 4,ENCRYPTED\n", ""), plain.replace(body[:4], "a:b\n"), sealed.replace("=", "!").replace("AAEC", "A!EC")):
        assert 3 not in [k for _, k, _ in secrets.find_spans(text)]



def test_sealed_keys_and_nested_lengths():
    octets = der(0x04, bytes(range(64)))
    oid = der(0x06, bytes.fromhex("2a864886f70d01050d"))
    sealed = der(0x30, der(0x30, oid + der(0x30, der(0x04, b"salt") + der(0x02, b"\x08"))) + octets)
    assert secrets.is_sealed_key(sealed) and not secrets.is_sealed_key(sealed + b"x") and not secrets.is_sealed_key(octets)
    wrap = lambda b: "-----BEGIN ENCRYPTED PRIVATE KEY-----\n" + base64.b64encode(b).decode() + "\n-----END ENCRYPTED PRIVATE KEY-----"
    assert [k for _, k, _ in secrets.find_spans(wrap(sealed))] == [3]
    assert [k for _, k, _ in secrets.find_spans(wrap(bytes(range(80))))] == []
    head = der(0x02, b"\0") + der(0x30, der(0x06, bytes.fromhex("2a864886f70d010101")) + der(0x05, b""))
    whole = der(0x30, head + der(0x04, rsa_key()))
    assert secrets.is_der_private_key(whole)
    assert not secrets.is_der_private_key(der(0x30, head + der(0x04, rsa_key() + b"x")))
    assert not secrets.is_der_private_key(der(0x30, head + der(0x04, b"\x30\x05abc")))


def test_spans_of_long_and_repeated_texts(spark):
    key = base64.b64encode(rsa_key()).decode()
    parts = ["token = abcdefgh12", "AKIA" + "Z9" * 10, "ab" * 20, key, jwt({"alg": "none"})]
    text, at, want = "", [], []
    for k, part in enumerate(parts * 3):
        text += f" {prose(2000, k)} "
        at.append(len(text))
        text += part
    for k, (start, part) in enumerate(zip(at, parts * 3)):
        kind = ("assign", "access", "hex", "b64key", "jwt")[k % 5]
        want.append(f"{kind}:{start}:{start + len(part)}")
    rows = secrets.scan_secrets(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert [r.spans for r in rows] == [",".join(want)] * 2 and [r.n_confirmed for r in rows] == [6, 6]


def brute_base(text):
    import re

    out = []
    for k, (pattern, flags, least) in enumerate(
        ((r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24))
    ):
        for m in re.finditer(pattern, text, flags):
            if len(m[2] if k == 0 else m[0]) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_by_brute_force(spark, awkward, nothing):
    rng = random.Random(5)
    bits = ["password", "TOKEN", "api_key", "apikey", "=", ": ", '"', " ", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "\n", "secret=token: abcdefgh", "K"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan_secrets(df).collect():
        want = brute_base(texts[r.doc_id] or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in want) for k in range(3))
    assert secrets.scan_secrets(awkward).count() == len(AWKWARD)
    assert secrets.scan_secrets(nothing).count() == 0
    assert secrets.redact("a token = abcdefgh1 b") == "a [SECRET] b"


# 9 and components


def brute_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(values, near):
    parent = {i: i for i in values}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(values)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if near(values[a], values[b]):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return {i: top(i) for i in keys}


@pytest.mark.parametrize("max_list", [4096, 3])
def test_fingerprint_links_by_brute_force(spark, max_list):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = set(base)
    for b in base:
        for _ in range(14):
            v = b
            for p in rng.sample(range(64), rng.randint(1, 6)):
                v ^= 1 << p
            values.add(v)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.link_fingerprints(df, 4, max_list)
    got = {r.node: r.comp for r in connected_components(links).collect()}
    want = brute_groups({v: v for v in signed}, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4)
    assert {v: got.get(v, v) for v in signed} == want


def test_near_duplicates(spark, awkward, nothing):
    texts = [(i, t) for i, t in AWKWARD if i is not None] + [(20, prose(200, 4)), (21, prose(200, 4) + " extra"), (22, prose(200, 5))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts}
    groups = brute_groups(prints, lambda a, b: bin(a ^ b).count("1") <= 4)
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}
    assert got[1][0] == "0" * 16 and got[2][1] == got[3][1] == 1
    assert simhash.near_duplicates(awkward).count() == len(AWKWARD)
    assert simhash.near_duplicates(nothing).count() == 0


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    text = prose(3000, 8)
    want = brute_fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 500)
    assert simhash.fingerprint(text, 4)[0] % (1 << 64) == want


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_near_groups_at_a_similarity(spark, nothing):
    rng = random.Random(2)
    rows, base = [], [prose(300, 50 + k).split() for k in range(6)]
    for k, words in enumerate(base):
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 4):  # one word in 300 differs: similarity about 0.97
            copy = list(words)
            copy[rng.randrange(300)] = f"other{c}"
            rows.append((10 * k + c, " ".join(copy)))
        far = list(words)
        for p in rng.sample(range(300), 60):  # similarity about 0.2
            far[p] = f"far{p}"
        rows.append((10 * k + 9, " ".join(far)))
    rows += [(1000, None), (1001, ""), (None, "lost")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in simhash_groups.near_groups(df).collect()}
    assert got == {i: (i // 10 * 10 if i % 10 < 9 else i) if i < 1000 else 1000 for i, _ in rows if i is not None}
    kept = simhash_groups.near_dedup_stage(spark, df, "")
    assert {r.doc_id for r in kept.collect()} == set(got.values()) | {None}
    assert kept.columns == df.columns
    assert simhash_groups.near_groups(nothing).count() == 0


def shingle_set(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute_similar_groups(rows, similarity=0.8):
    sets, top = [shingle_set(t) for _, t in rows], [i for i, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                old, new = max(top[a], top[b]), min(top[a], top[b])
                top = [new if x == old else x for x in top]
    return {i: x for (i, _), x in zip(rows, top)}


def test_near_groups_compare_all_of_long_lists(spark):
    fresh, words, rows = iter(f"new{k}" for k in range(10**6)), prose(300, 71).split(), []
    for i in range(14):  # each text has ten more new words in a row than the one before: a chain
        rows.append((i, " ".join(words)))
        at = i * 10 % 300
        words = words[:at] + [next(fresh) for _ in range(10)] + words[at + 10 :]
    want = brute_similar_groups(rows)
    assert set(want.values()) == {0}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in simhash_groups.near_groups(df, max_list=3).collect()} == want
    members = spark.range(20).selectExpr("id AS node", "id % 2 AS key", "10L AS n")
    groups = {}
    for r in simhash_groups.dealt(members, 3).collect():
        groups.setdefault((r.key, r.i, r.j), set()).add(r.node)
    for a in range(20):
        assert all(any({a, b} <= g for g in groups.values()) for b in range(a % 2, a, 2))


def test_near_groups_equal_brute_force(spark):
    rng, rows = random.Random(5), []
    for family in range(3):  # mostly one template: similarities on both sides of 0.8, lists of all of a family
        template = prose(200, 300 + family).split()
        for c in range(24):
            own = prose(rng.choice([20, 34, 50]), 1000 * family + c // 2).split()
            words = template + own
            for p in rng.sample(range(len(words)), rng.choice([0, 1, 2, 5, 8])):
                words[p] = f"sub{c}x{p}"
            rows.append((100 * family + c, " ".join(words)))
    for n in range(4, 16):  # short texts that differ in the last word only
        rows += [(1000 + 10 * n + c, f"{prose(n - 1, 500 + n)} last{c}") for c in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_similar_groups(rows)
    assert len(rows) > len(set(want.values())) > 3
    for longest in (3, 1024):
        assert {r.doc_id: r.group_id for r in simhash_groups.near_groups(df, max_list=longest).collect()} == want


def test_linked_forest():
    prints = np.array([[0], [1], [3], [255 << 8], [15], [254 << 8]], dtype=np.uint64)
    assert sorted(simhash_groups.linked_forest(prints, 2)) == [(0, 1), (0, 2), (2, 4), (3, 5)]


# 8


def brute_topk(rows, k=10):
    good = {i: [math.floor(float(np.float32(x)) * 1024) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(good):
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(good[q], good[d])), d) for d in good if d != q)
            out += [(q, r, d, -s) for r, (s, d) in enumerate(scored[:k], 1)]
    return out


def test_exact_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(330)]
    rows[5] = (5, None)
    rows[6] = (6, [1.0, None] + [0.0] * 6)
    rows[7] = (7, [float("nan")] * 8)
    rows[8] = (8, [float("inf")] + [0.0] * 7)
    for i in range(40, 80):
        rows[i] = (i, rows[39][1])  # ties
    rows += [(None, [1.0] * 8), (400, [1.0, 2.0]), (401, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, chunk string, slot int")
    q = topk.quantized(df)
    got = topk.top_k(q, q.where("vec_id % 100 = 0"), chunk=64, block=16, query_block=3, slots=3)
    assert sorted(map(tuple, got.collect())) == sorted(brute_topk(rows))
    many = topk.top_k(q, q.where("vec_id % 100 = 0"), chunk=50, block=16, query_block=1, group=1, slots=2)
    assert sorted(map(tuple, many.collect())) == sorted(brute_topk(rows))
    few = topk.quantized(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in topk.top_k(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, 2048 * 1024)]
    none = few.where("vec_id < 0")
    assert topk.top_k(none, none).count() == 0


# 6


def test_quality_selection(spark, nothing):
    good = [(i, prose(60, i)) for i in range(200)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(60, 5000 + i).split())) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "l", 1.0) for i, t in [*good, *junk, (2000, None), (2001, "")]], "doc_id long, text string, x string, log_weight double")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)] + [(1000 + i, 0) for i in range(30)] + [(None, 1)], "doc_id long, quality int")
    model, keys, least = quality.select(docs, labels)
    chosen = {r.doc_id for r in keys.where(keys.sample_key >= least).collect()}
    assert chosen >= set(range(200)) and not chosen & set(range(1000, 1060))
    assert model.weight(None) == model.weight("") == 0.0
    _, empty_keys, _ = quality.select(nothing, labels)
    assert empty_keys.count() == 0
    model, _, least = quality.select(docs, labels.where("quality > 1"))
    assert least == -math.inf or all(r.sample_key >= least for r in keys.limit(0).collect())


def ngrams(text, buckets):
    """Buckets of words and of pairs of neighbouring words; a pair of equal words is one n-gram whatever the word."""
    import re

    h = [zlib.crc32(w.encode()) for w in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
    out = [x % buckets for x in h]
    for a, b in zip(h, h[1:]):
        x = (a * 0x9E3779B1 + b) % 2**64
        out.append(1 if a == b else (x ^ (x >> 29)) % buckets)
    return out


def test_quality_by_brute_force(spark):
    rng, buckets = random.Random(31), 256
    docs = [(i, prose(rng.randint(0, 40), i) + (" ###" * rng.randint(0, 9) if i % 3 == 0 else "")) for i in range(150)]
    docs += [(7, docs[7][1]), (200, None), (201, "tie"), (202, "tie")]
    target = [i for i in range(150) if i % 3]
    model = quality.fit(spark.createDataFrame(docs, "doc_id long, text string"), target, buckets=buckets, seed=7, noise=1.0)
    raw, wanted = Counter(), Counter()
    for i, t in docs:
        raw.update(ngrams(t, buckets))
        if i in target:
            wanted.update(ngrams(t, buckets))
    ratio = lambda b: math.log((wanted[b] + 1) / (sum(wanted.values()) + buckets)) - math.log((raw[b] + 1) / (sum(raw.values()) + buckets))
    got = model.keys(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id, r.log_weight)), sorted(docs, key=lambda d: d[0])):
        weight = sum(ratio(b) for b in ngrams(t, buckets))
        u = (xxhash.xxh64_intdigest(str(i).encode(), 7) + 0.5) / 2**64
        assert r.doc_id == i and r.log_weight == pytest.approx(weight, abs=1e-9)
        assert r.sample_key == pytest.approx(weight - math.log(-math.log(u)), abs=1e-9)
    keys = sorted((r.sample_key for r in got), reverse=True)
    table = spark.createDataFrame([(k,) for k in keys], "k double")
    assert [quality.kth_largest(table, "k", k, bins=4) for k in (1, 20, len(keys))] == [keys[0], keys[19], keys[-1]]


def test_weights_by_brute_force(monkeypatch):
    model = quality.QualityModel(np.arange(64, dtype=float), 1, 1.0)
    text = prose(500, 3) + " ### a a a"
    whole = model.weight(text)
    monkeypatch.setattr(quality, "BLOCK", 100)
    assert model.weight(text) == pytest.approx(whole)


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.random(), 0.5, -3.0, 1e6 * rng.random()]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 77, 250, 499, 500):
        assert quality.kth_largest(df, "x", k, bins=8) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "x", 501) == -math.inf


# 5


def test_decontamination(spark, nothing):
    item = [f"w{k}" for k in range(40)]
    changed = [w if k % 9 else f"sub{k}" for k, w in enumerate(item)]
    rows = [
        (1, "intro words here " + " ".join(item) + " outro", True), (2, "a b c " + " ".join(changed) + " d", True), (3, prose(500, 1), False),
        (4, None, False), (5, "", False), (6, " ".join(item[:20]) + " then something else", True), (7, " ".join(item[:8]), False),
        (8, "x SHORT item Of five, y", True), (8, "x SHORT item Of five, y", True),
    ]
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, None), (2, "short item of five y"), (3, "w1 w2")], "item_id long, text string")
    got = decontaminate.find_overlaps(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 0), (1, 3), (2, 0), (2, 3), (6, 0), (6, 3), (7, 3), (8, 2), (8, 2)]
    five = decontaminate.find_overlaps(docs, bench, least_item=5).collect()
    assert sorted((r.doc_id, r.item_id) for r in five) == [(1, 0), (2, 0), (6, 0), (8, 2), (8, 2)]
    by = {r.doc_id: r for r in five}
    assert (by[1].start_word, by[1].n_words, by[1].n_equal) == (3, 40, 40)
    blocks = decontaminate.find_overlaps(docs, bench, max_block=10)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, got))
    assert decontaminate.find_overlaps(nothing, bench).count() == 0
    assert decontaminate.find_overlaps(docs, bench.limit(0)).count() == 0


def brute_overlaps(docs, items, least=13, share=0.8):
    """Pairs of which some alignment has ``least`` words (or the whole item) with the share equal."""
    out = set()
    for d, text in docs:
        for i, item in items:
            n = min(least, len(item))
            for shift in range(-len(item) + 1, len(text)):
                same = [0 <= k + shift < len(text) and text[k + shift] == w for k, w in enumerate(item)]
                lo, hi = max(0, -shift), min(len(item), len(text) - shift)
                if any(sum(same[a:b]) >= share * (b - a) - 1e-9 for a in range(lo, hi) for b in range(a + n, hi + 1)):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_decontamination_by_brute_force(monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SLICE", limit)
    rng = random.Random(21)
    pool = [f"p{k}" for k in range(30)]
    items = [(i, [rng.choice(pool) for _ in range(rng.choice((1, 2, 3, 6, 9, 13, 15, 22)))]) for i in range(25)]
    docs = []
    for d in range(40):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 30))]
        item = rng.choice(items)[1]
        copied = [w if rng.random() > 0.12 else "sub" for w in item]
        docs.append((d, [*text, *copied, *(rng.choice(pool) for _ in range(6))]))
    index = decontaminate.SeedIndex(items)
    found = index.search([index.words(" ".join(t)) for _, t in docs])
    assert {(d, index.names[i]) for d, i, *_ in found} == brute_overlaps(docs, items)


def test_decontamination_of_a_very_long_text(spark):
    item = prose(30, 77)
    docs = spark.createDataFrame([(1, f"{LONG} {item} {LONG}"), (1, f"{LONG} {item} {LONG}"), (2, LONG)], "doc_id long, text string")
    got = decontaminate.find_overlaps(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.start_word, r.n_words) for r in got] == [(1, 60_000, 30)] * 2


def test_decontamination_finds_every_overlap_of_the_share():
    rng = random.Random(9)
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 19, 20, 25, 31, 40)}
    index = decontaminate.SeedIndex([(n, words) for n, words in items.items()])
    for n, words in items.items():
        spare = n - math.ceil(0.8 * n - 1e-9)
        sets = list(itertools.combinations(range(n), spare))
        for gone in sets if len(sets) < 500 else rng.sample(sets, 300):
            text = " ".join(["before"] * 4 + [f"sub{k}" if k in gone else w for k, w in enumerate(words)] + ["after"] * 4)
            found = index.search([index.words(text)])
            assert [index.names[x[1]] for x in found] == [n], (n, gone)
            assert found[0][3] >= min(13, n) and found[0][4] >= 0.8 * found[0][3], (n, gone)
        if n < 13:  # one substitution more is too many
            text = " ".join(f"sub{k}" if k <= spare else w for k, w in enumerate(words))
            assert index.search([index.words(text)]) == []


# 1


def test_url_parts_rules_and_verdicts(spark):
    rows = [
        (1, "https://A.Example.ORG/es/x?q#f"), (2, "http://example.org/en/12"), (3, "http://x.org"), (4, None), (5, "no scheme/de/"), (6, "://com/fr/"),
        (7, "http://notcom/fr/"), (8, "http://a.com/de/y"), (9, "x://h?a://b/c#d"), (9, "x://h?a://b/c#d"), (10, ""),
    ] + [(100 + i, f"http://s{i % 7}.example.{'com' if i % 2 else 'org'}/{'de' if i % 3 else 'fr'}/{i}") for i in range(200)]
    df = spark.createDataFrame([(i, u, "host") for i, u in rows], "page_id long, url string, suffix string")
    got = {r.page_id: r for r in urls.filter_urls(df, n_trees=3, depth=2).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(1, 11)] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("x.org", "", None), ("", "", None), ("", "", None),
        ("com", "/fr/", "com/fr/"), ("notcom", "/fr/", None), ("a.com", "/de/y", "com/de/"), ("h", "", None), ("", "", None),
    ]
    assert got[1].verdict == "block" and got[6].verdict == "allow" and got[8].verdict == "block"
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        bad = rng.random() < 0.5
        tail = "".join(rng.choice("0123456789") for _ in range(12)) if bad else "".join(rng.choice("abcdef") for _ in range(8))
        rows.append((f"http://h{i % 20}.net/{tail}", int(bad)))
    df = spark.createDataFrame(rows, "url string, blocked int")
    model = urls.fit_url_model(df.limit(400), n_trees=4, depth=2)
    held = df.selectExpr("url AS url_text", "blocked")
    held = held.withColumn("host", urls.host_of(held.url_text)).withColumn("path", urls.path_of(held.url_text))
    hit = [(r.block_score >= 0.5) == bool(r.blocked) for r in model.score(held).collect()]
    assert sum(hit) / len(hit) > 0.95


# 7


def test_weighted_urls_learn_like_repeated_ones(spark):
    rng = random.Random(3)
    rows = [(f"http://host{k % 7}.com/{'x' * rng.randint(0, 9)}{k}", int(k % 7 < 3)) for k in range(60)]
    many = rows + [rows[0]] * 500 + [rows[4]] * 200 + [("http://long.com/" + "y" * 40_000, 1)]
    model = urls.fit_url_model(spark.createDataFrame(many, "url string, blocked int"), max_training_rows=10_000, n_trees=2)
    few = {r.suffix: r.suffix_rate for r in model.suffixes.collect()}
    for suffix, n, y in [("host0.com", 509, 509), ("host4.com", 209 - 1, 0)]:
        n = sum(u.split("/")[2] == suffix for u, _ in many)
        y = sum(b for u, b in many if u.split("/")[2] == suffix)
        assert few[suffix] == pytest.approx((y + 4 * model.prior) / (n + 4))
    assert model.prior == pytest.approx((sum(b for _, b in many) + 0.5) / (len(many) + 1))


def test_revisits(spark):
    h = lambda **k: {x.replace("_", "-"): v for x, v in k.items()}
    rows = [
        (1, "http://www.A.com:80/x/?utm_source=f", 10, "response", '"t1"', None, "d1", h(Content_Type="text/html", Date="10", ETag='"t1"')),
        (2, "https://a.com/x", 20, "response", '"t2"', None, "d2", h(Content_Type="text/plain", Date="20")),
        (3, "http://a.com/x#frag", 15, "revisit", 'W/"t1"', None, None, h(Date="15", Content_Length="0", Vary="a")),
        (4, "http://a.com/x", 25, "revisit", '"t1"', None, None, None),
        (5, "http://a.com/x", 5, "revisit", '"t1"', None, None, h(Date="5")),
        (6, None, 30, "revisit", "e", None, None, None),
        (7, "http://a.com/x", 20, "revisit", None, None, "d2", h(Set_Cookie="no", ETag="n")),
        (7, "http://a.com/x", 20, "revisit", None, None, "d2", h(Set_Cookie="no", ETag="n")),
        (8, "http://a.com/x", 40, "other", None, None, None, None),
    ]
    df = spark.createDataFrame(
        [(*r, "k") for r in rows],
        "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, near string",
    )
    for slices in (1, 64):
        got = sorted((r.record_id, r.refers_to, r.outcome, tuple(sorted(r.headers.items()))) for r in warc.resolve_revisits(df, slices).collect())
        assert got == [
            (3, 1, "resolved", (("content-type", "text/html"), ("date", "15"), ("etag", '"t1"'), ("vary", "a"))),
            (4, 2, "mismatch", ()),
            (5, None, "unresolved", (("date", "5"),)),
            (6, None, "unresolved", ()),
            *[(7, 2, "resolved", (("content-type", "text/plain"), ("date", "20"), ("etag", "n")))] * 2,
        ]
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_warc_records_are_parsed(spark):
    def record(kind, number, url, date, http, extra=""):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:capture:{number}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n{extra}Content-Length: {len(http)}\r\n\r\n{http}"

    ok = "HTTP/1.1 200 OK\r\nETag: \"a:b\"\r\netag: second\r\nBroken line\r\n\r\n<p>body\r\n\r\nETag: no</p>"
    long = "http://long.org/" + "x" * 50_000
    rows = [
        record("response", 1, "http://a.org/", "2026-01-01T00:00:00Z", ok, "warc-payload-digest: md5:1\r\n"),
        record("response", 2, "http://a.org/", "2026-01-01T00:00:01Z", "HTTP/1.1 404 Not Found\r\n\r\n"),
        record("revisit", 3, "http://www.a.org", "2026-01-01T00:00:05+00:00", 'HTTP/1.1 304 Not Modified\r\nETag: W/"a:b"\r\nVary: x\r\n\r\n'),
        record("revisit", 3, "http://www.a.org", "2026-01-01T00:00:05Z", 'HTTP/1.1 304 Not Modified\r\nETag: W/"a:b"\r\nVary: x\r\n\r\n'),
        record("metadata", 4, "http://a.org/", "2026-01-01T00:00:06Z", ""), record("revisit", 5, long, "no date", ""), None, "", "not a record", "WARC/1.0",
    ]
    df = spark.createDataFrame([(r, "x", 1) for r in rows], "record string, kind string, ts int")
    got = {r.record_id: r for r in warc.parse_records(df).collect()}
    assert set(got) == {1, 3, 5} and got[1].etag == '"a:b"' and got[1].digest == "md5:1" and got[1].headers == {"etag": '"a:b"'}
    assert got[3].ts - got[1].ts == 5 and got[5].ts is None and got[5].url == long and got[5].headers == {}
    out = sorted((r.record_id, r.refers_to, r.outcome, tuple(sorted(r.headers.items()))) for r in warc.resolve_revisits(warc.parse_records(df)).collect())
    assert out == [(3, 1, "resolved", (("etag", 'W/"a:b"'), ("vary", "x")))] * 2 + [(5, None, "unresolved", ())]
    assert warc.parse_records(df.limit(0)).count() == 0


def test_revisits_at_random_by_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, f"http://h/{rng.randrange(4)}", rng.randrange(60), rng.choice(["response", "revisit"]), rng.choice("ab"), None, None, None) for i in range(300)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    want = {}
    for r in rows:
        if r[3] == "revisit":
            before = [x for x in rows if x[3] == "response" and x[1] == r[1] and (x[2], x[0]) < (r[2], r[0])]
            hit = max(before, key=lambda x: (x[2], x[0]), default=None)
            want[r[0]] = (hit and hit[0], "unresolved" if not hit else "resolved" if hit[4] == r[4] else "mismatch")
    assert {r.record_id: (r.refers_to, r.outcome) for r in warc.resolve_revisits(df, 16).collect()} == want


# 4
