"""Each operator against brute force on a small fixture, and its defined cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import heapq
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verifold.llm import media, mixing, near_dedup, packing, pii, quality, secrets, sharding, substring
from verifold.llm.html import extract_text, main_text

SPACE = r"[^\x20\x09-\x0D]+"


def base_texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    prose = [" ".join(rng.choice(words, n)) + "." for n in (30, 45, 60, 25, 200, 33)]
    passage = " ".join(rng.choice(words, 64))
    return [
        prose[0], prose[1], prose[2], prose[0],
        prose[1].replace(prose[1].split()[20], "changed", 1),
        f"{prose[3]} {passage} {prose[5]}", f"{prose[4]}\n{passage}", "", "   \n\t", None,
        "alpha beta", "alpha beta", "line one is here.\nline one is here.\nÜmlaut é😀 end.", prose[4] * 3, "x " * 5000, "a b c d e f g h " * 12,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(base_texts())]
    rows += [rows[2], (None, "null id text with some words in it", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words_of(text):
    return re.findall(SPACE, text or "")


def test_quality(docs, empty):
    clash = docs.withColumn("n_words", F.lit("mine")).withColumn("_words", F.lit(1)).withColumn("_t", F.lit(2))
    got = quality.score(clash).collect()
    assert all(r["_words"] == 1 and r["_t"] == 2 for r in got)
    assert len(got) == docs.count()
    for r in got:
        ws = words_of(r["text"])
        assert r["n_words"] == len(ws) and r["word_chars"] == sum(map(len, ws))
        seen, dup = set(), 0
        for line in (r["text"] or "").split("\n"):
            if words_of(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        covered = {i + k for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for k in range(8)}
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (dup, len(covered))
        assert r["base_failed"] == (len(ws) < 20 or 100 * len(covered) > 30 * len(ws))
        assert not (r["base_failed"] and r["kept"])
    assert quality.score(empty).count() == 0
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in kept.collect())


def test_quality_lines(spark):
    lines = ["Home | About us | Contact", "We use cookies to improve this site.", "skip to content", "One whole sentence of prose stands here.", "###### $$$$ ****"]
    d = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    assert quality.score(d).first()["cleaned_text"] == lines[3]
    long = spark.createDataFrame([(1, "aa | " * 50000), (2, "word. " * 50000), (3, "x" * 500000)], "doc_id long, text string")
    assert [r["kept"] for r in quality.score(long).orderBy("doc_id").collect()] == [False, False, False]


def removal(rows, width=20):
    first, out = {}, {}
    for i, t in rows:
        ws = words_of(t)
        gone = set()
        for p in range(len(ws) - width + 1):
            key = tuple(ws[p : p + width])
            if key in first:
                gone |= set(range(p, p + width))
            else:
                first[key] = (i, p)
        out.setdefault(i, []).append((len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def test_substring(docs, empty, monkeypatch):
    monkeypatch.setattr(substring, "GROUP_BYTES", 2000)
    got = substring.dedup_substrings(docs.withColumn("g", F.lit(1)).withColumn("range", F.lit(2))).collect()
    order = lambda r: (-1 if r[0] is None else r[0], hashlib.md5(json.dumps({"doc_id": r[0], "text": r[1] or ""}, separators=(",", ":")).encode()).hexdigest())
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=order)
    expected = removal(rows)
    found = defaultdict(list)
    for r in got:
        found[r["doc_id"]].append((r["n_words"], r["n_removed"], r["kept_text"]))
        assert sum(s["end"] - s["start"] for s in r["intervals"]) == r["n_removed"]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert substring.dedup_substrings(empty).count() == 0


def test_secrets(spark, empty):
    def b64(x):
        import base64

        return base64.b64encode(x).decode()

    jwt = ".".join(x.replace("+", "-").replace("/", "_").rstrip("=") for x in (b64(json.dumps({"alg": "HS256"}).encode()), b64(json.dumps({"sub": 1}).encode()), "c2ln"))
    inner = bytes([2, 1, 0]) + bytes([2, 32]) + bytes(range(32))
    der = bytes([0x30, len(inner)]) + inner
    ssh = b"\0\0\0\x07ssh-rsa" + b"\0\0\0\x20" + bytes(range(32))
    pem = f"-----BEGIN PRIVATE KEY-----\n{b64(der)}\n-----END PRIVATE KEY-----"
    texts = [
        f'é😀 token = "{"ab12" * 10}" and api_KEY:secret99', "AKIA" + "A" * 16 + " AKIASHORT", f"see {jwt} ok", f"k {b64(ssh)} e", pem, der.hex(), "token=abc", None, "", "eyJhbGciOi.abc.def",
        "token=token:abcdefgh",
    ]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("secret_spans", F.lit(0))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["secret_spans"]] for r in secrets.scan_secrets(d).collect()}
    assert [k for k, _, _ in got[0]] == ["assign", "hex", "assign"] and got[0][0][1] == 3
    assert got[1] == [("access", 0, 20)]
    assert got[2] == [("jwt", 4, 4 + len(jwt))]
    assert got[3] == [("sshkey", 2, 2 + len(b64(ssh)))]
    assert got[4] == [("pem", 0, len(pem))]
    assert [k for k, _, _ in got[5]] == ["hex", "der"]
    assert [got[i] for i in (6, 7, 8, 9, 10)] == [[], [], [], [], []]
    assert secrets.scan_secrets(empty).count() == 0


def base_secrets(text):
    out = []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [("assign", m.start(), m.end())] * (len(m[1]) >= 6)
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def test_secrets_base_random():
    rng = np.random.default_rng(2)
    parts = ["token", " = ", ":", "abc", "AKIA", "A" * 17, "f00d" * 7, "secret", "\"", "Password", "api_key", " ", "ſecret", "é", "12"]
    for _ in range(400):
        text = "".join(rng.choice(parts, 12))
        got = [s for s in secrets.find_secrets(text) if s[0] in secrets.BASE_KINDS]
        assert sorted(got) == sorted(base_secrets(text))


def test_media(docs, empty):
    store = media.read_store(media.media_store(docs))
    pages = media.interleave(media.as_pages(docs))
    got = media.references(pages, store, ["doc_id"]).collect()
    texts = Counter()
    by_id = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(got) == 2 * docs.count()
    for r in got:
        raw = by_id[r["doc_id"]].encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        assert r["n_bytes"] == len(raw) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["payload_bytes"] == len(payload) and r["media_bytes"] > len(payload)
        said = f"Document {'null' if r['doc_id'] is None else r['doc_id']}"
        assert r["caption"] == (said if r["ordinal"] == 0 else f"{said}, again")
        texts[by_id[r["doc_id"]], r["feature"]] += 1
    assert len({t for t, _ in texts}) == len(texts)
    for r in pages.collect():  # lines and references in their order
        first, *rest = by_id[r["doc_id"]].split("\n")
        lines = lambda x: [("text", " ".join(y.split())) for y in x if y.split()]
        want = [*lines([first]), ("media", None), *lines(rest), ("media", None)]
        assert [(p["kind"], p["text"]) for p in r["parts"]] == want and [p["position"] for p in r["parts"]] == list(range(len(want)))
    assert media.media_store(empty).count() == 0 and media.interleave(media.as_pages(empty)).count() == 0
    assert media.references(media.interleave(media.as_pages(empty)), store, ["doc_id"]).count() == 0


def test_interleaved_order():
    page = '<p>one</p><figure><img src="sha256:AB"><img src="sha256:cd" alt="x"><figcaption>Both &amp; more</figcaption></figure>two<script>no</script><img src="http://x"><img src="sha256:ef" alt="last">'
    parts = media.parse_parts(page)
    assert [(p["position"], p["kind"], p.get("text") or p["digest"], p.get("caption")) for p in parts] == [
        (0, "text", "one", None), (1, "media", "ab", "Both & more"), (2, "media", "cd", "Both & more"), (3, "text", "two", None), (4, "media", None, None), (5, "media", "ef", "last"),
    ]
    assert parts[4]["source"] == "http://x" and media.parse_parts(None) == []


def test_interleaving_loses_no_text():
    said = lambda html: [p.get("text") or (p["source"], p["caption"]) for p in media.parse_parts(html)]
    assert said("a<figure><img src=x><figcaption>cap</figure>b<p>c") == ["a", ("x", "cap"), "b", "c"]
    assert said("<figure><img src=x><figcaption>cap <p>more") == [("x", "cap more")]
    assert said("<figure><figcaption>alone</figcaption><p>in it</figure>z") == ["in it", "alone", "z"]
    assert said("<script/><p>still here") == ["still here"]
    assert said("<figure><figure><img src=i><figcaption>inner</figcaption></figure><img src=o><figcaption>outer</figcaption></figure>") == [("i", "inner"), ("o", "outer")]
    assert said("<video poster=p.png><source src=v.mp4></video><img srcset='s.png 2x, t.png'>t") == [("p.png", None), ("v.mp4", None), ("s.png", None), "t"]
    assert media.parse_parts("<img src='data:text/plain;base64,YWI='>")[0]["digest"] == hashlib.sha256(b"ab").hexdigest()
    assert said("&#" + "9" * 9000 + ";x") == ["\ufffdx"]


def brute_parts(html):
    """Texts and sources of well-formed pages, by splitting at tags."""
    import html as H

    out, said = [], []
    for token in re.split(r"(<[^>]*>)", html):
        if token.startswith("<"):
            if re.match(r"</?(p|img|figure|figcaption)", token):
                text, said = " ".join("".join(said).split()), []
                if text:
                    out.append(text)
                if m := re.search('src="([^"]*)"', token):
                    out.append((m[1], None))
                if token == "</figcaption>":
                    caption = out.pop()
                    out[-1] = (out[-1][0], caption)
        else:
            said.append(H.unescape(token))
    return out


def test_interleaving_against_a_plain_version():
    rng = np.random.default_rng(6)
    for _ in range(200):
        page = "".join(
            [f"<p>{rng.choice(['a &lt; b', 'c  d', ''])}</p>", f'<img src="s{k}">', f'<figure><img src="f{k}"><figcaption>cap {k}</figcaption></figure>', f"<p>t<b>x</b>{k}</p>"][int(rng.integers(4))]
            for k in range(int(rng.integers(8)))
        )
        assert [p.get("text") or (p["source"], p["caption"]) for p in media.parse_parts(page)] == brute_parts(page), page


def test_resolved_sequences(spark, docs):
    store = media.read_store(media.media_store(docs.where("doc_id = 2"))).cache()
    digest = store.first()["digest"]
    html = f'one<img src="sha256:{digest}" alt="here">two<img src="sha256:{"0" * 64}">three<img src="http://y">'
    rows = [(1, html), (1, html), (2, "no media"), (3, None)]
    pages = media.interleave(spark.createDataFrame(rows, "id long, html string").withColumn("resolved", F.lit("mine")).withColumn("_row", F.lit("my own")))
    got = sorted(media.resolve(pages, store).collect(), key=lambda r: r["id"])
    assert len(got) == 4 and all(r["_row"] == "my own" for r in got) and got[3]["resolved"] == []
    for r in got[:2]:
        assert [x["text"] or (x["media"] and x["media"]["digest"]) for x in r["resolved"]] == ["one", digest, "two", None, "three", None]
        assert r["resolved"][1]["caption"] == "here"
    assert [x["text"] for x in got[2]["resolved"]] == ["no media"]
    assert media.resolve(pages.limit(0), store).count() == 0


def luhn(d):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d)))) % 10 == 0


def base_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", m.start(), m.end())] * (13 <= len(d) <= 19 and luhn(d))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii(spark, empty):
    rng = np.random.default_rng(3)
    parts = ["a.b@c-d.example", "10.0.0.256", "001.02.3.4", "4111 1111-1111 1111", "+1 (555) 010-2030", "é😀", " ", "7", "1.2.3.4.5", "@", ".", "x", "4532015112830366", "-", "+", "9" * 25]
    texts = ["".join(rng.choice(parts, 9)) for _ in range(150)] + [None, "", "1 " * 20000, "word " * 30000 + "a@b.cd"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii_base", F.lit("mine"))
    got = pii.find_pii(d).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [(s["kind"], s["start"], s["end"]) for s in r["pii_spans"] if s["kind"] != "context"] == base_pii(r["text"] or ""), r["text"]
    assert pii.find_pii(empty).count() == 0


def test_pii_bootstrap_and_redaction(spark):
    rows = [f"please reach me at +1 (555) 010-20{i:02d} today" for i in range(10, 20)] + [f"her desk number: a{i}@mail.example end" for i in range(5)]
    rows += ["please reach me at X9988-77665 soon", "his desk number: 5551234 end", "the code 123456 is not one"]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = {r["doc_id"]: r for r in pii.find_pii(d).collect()}
    found = {i: [rows[i][s["start"] : s["end"]] for s in r["pii_spans"] if s["kind"] == "context"] for i, r in got.items()}
    assert found[15] == ["X9988-77665"] and found[16] == ["5551234"] and found[17] == [] and not any(found[i] for i in range(15))
    out = {r["doc_id"]: r for r in pii.redact(d).collect()}
    assert out[0]["text"] == "please reach me at [PHONE] today" and out[15]["text"] == "please reach me at [CONTEXT] soon" and out[17]["text"] == rows[17]
    assert out[0]["n_chars"] == len(out[0]["text"])


def test_schedule_is_the_heap():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 7))
        classes = [(int(s), int(rng.choice([1, 2, 7, 300]))) for s in rng.choice(60, 6, replace=False) + 1]
        heap = [(0, i) for i in range(n)]
        for size, count in sorted(classes, reverse=True):
            for _ in range(count):
                load, i = heap[0]
                heapq.heapreplace(heap, (load + size, i))
        loads = dict.fromkeys(range(n), 0)
        for size, shards, ends in sharding.schedule([(s, c, s) for s, c in classes], n):
            for s, a, b in zip(shards, [0, *ends], ends, strict=False):
                loads[s] += (b - a) * size
        assert loads == {i: load for load, i in heap}


def test_sharding(docs, empty):
    got = sharding.lpt_shards(docs, 4).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    places, shards = defaultdict(set), defaultdict(list)
    for r in got:
        raw = by_id[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
        places[raw].add(r["shard"])
        shards[r["shard"]].append(r["slot"])
    assert all(len(x) == 1 for x in places.values())
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())
    assert sharding.lpt_shards(empty).count() == 0


def test_packing(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = docs.sparkSession.createDataFrame([(100, "it's <|endoftext|> 12 naïve  x\n\n y" + " z" * 1500)], "doc_id long, text string")
    d = docs.select("doc_id", "text").unionByName(extra)
    got = packing.pack_documents(d.withColumn("length", F.lit(1)), 256).collect()
    texts = Counter((r["doc_id"], r["text"]) for r in d.collect())
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    expected = Counter()
    for (doc_id, text), n in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for a in range(0, len(ids), 256):
            expected[doc_id, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes()), len(ids)] += n
    assert pieces == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(empty).count() == 0


def test_shortest_pack_first():
    rng = np.random.default_rng(4)
    for _ in range(50):
        histogram = {int(k): int(v) for k, v in zip(rng.choice(64, 12, replace=False) + 1, rng.integers(1, 90, 12), strict=True)}
        used = Counter()
        for count, lengths in packing.shortest_pack_first(histogram, 64):
            assert sum(lengths) <= 64
            for x in lengths:
                used[x] += count
        assert used == histogram


def test_mixing(docs, empty):
    weights = {"s0": 6.0, "s1": 1.0}
    rates = {r["_source"]: (r["_n_docs"], r["_rate"]) for r in mixing.source_rates(docs, weights, 3.0).collect()}
    total = sum(n * rate for n, rate in rates.values())
    assert total == pytest.approx(3.0 * docs.count()) and rates["s0"][0] * rates["s0"][1] == pytest.approx(6 * rates["s1"][0] * rates["s1"][1])
    got = mixing.mix_poisson(docs.withColumn("mix_key", F.lit("mine")), weights, 3.0).collect()
    per = defaultdict(list)
    for r in got:
        per[r["doc_id"], r["mix_copies"]].append(r["mix_copy"])
    by_id = Counter(r["doc_id"] for r in docs.collect())
    for (doc_id, n), copies in per.items():
        assert sorted(copies) == sorted(list(range(1, n + 1)) * by_id[doc_id])
    assert mixing.mix_poisson(empty).count() == 0


def test_poisson_inversion(spark):
    from math import exp

    d = spark.range(2000).select((F.col("id") / 2000).alias("u")).crossJoin(spark.createDataFrame([(0.0,), (0.3,), (2.5,), (900.0,)], "rate double"))
    rows = d.withColumn("k", mixing.poisson_count(F.col("rate"), F.col("u"))).collect()
    for rate in (0.3, 2.5):
        for r in (x for x in rows if x["rate"] == rate):
            k, term = 0, exp(-rate)
            cdf = term
            while cdf < r["u"]:
                k += 1
                term *= rate / k
                cdf += term
            assert r["k"] == k
    big = [r["k"] for r in rows if r["rate"] == 900.0 and r["u"] > 0]
    assert abs(np.mean(big) - 900) < 1 and abs(np.std(big) - 30) < 1
    assert all(r["k"] == 0 for r in rows if r["rate"] == 0.0)


def multiset(text):
    ws = words_of(text)
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else Counter([tuple(ws)] if ws else [])


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows):
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [multiset(t) for _, t in rows]
    for x in range(len(rows)):
        for y in range(x):
            if (rows[x][1] or "") == (rows[y][1] or "") or sets[x] and sets[y] and jaccard(sets[x], sets[y]) >= 0.8:
                parent[top(x)] = top(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[top(x)] = min(least.get(top(x), i), i)
    return Counter((i, least.get(top(x))) for x, (i, _) in enumerate(rows))


def test_near_duplicates(spark, docs, empty):
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in range(300)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = list(rng.choice(words, 150))
    for k in range(40):  # a family of copies of copies, many of them under the threshold to most others
        copy = list(base)
        for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            copy[at] = f"edit{k}"
        base = copy if k % 3 == 0 else base
        rows.append((1000 + k, " ".join(copy)))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("mine")).withColumn("class_id", F.lit("mine"))
    got = Counter((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(d).collect())
    assert got == brute_classes(rows)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, c in brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])})


def test_one_row_stays_of_repeated_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(2, text, "x"), (5, text + " b", "x"), (5, "some other text of its own", "x"), (5, "some other text of its own", "y"), (None, "nobody has this id", "x"), (None, "nobody has this id", "x")]
    got = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, node string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("2", text), ("5", rows[2][1]), ("None", rows[4][1])]


def test_blocks_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = np.random.default_rng(11)
    words = [f"v{i}" for i in range(300)]
    base, rows = list(rng.choice(words, 120)), []
    for k in range(60):
        copy = list(base)
        for at in rng.choice(120, int(rng.integers(1, 14)), replace=False):
            copy[at] = f"e{k % 7}"
        rows.append((k, " ".join(copy)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(d).collect()) == brute_classes(rows)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(40)]
    a = " ".join(rng.choice(words, 60)) + " "
    texts = [a * 7 + "p q r s t", a * 3 + "p q r s t u", a, a * 13]
    names = near_dedup.signatures(*near_dedup.multiset(*near_dedup.shingles(pa.array(texts), 5)), 4, 4096)
    for i in range(4):
        for j in range(i):
            assert abs((names[i] == names[j]).mean() - jaccard(multiset(texts[i]), multiset(texts[j]))) < 0.03


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h2>Site of the year</h2></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="cookie-notice">We use cookies on this site.</div><div id="content">
<h1>A title of the story</h1><p>The quick fox is in the wood and it was seen by all of us at the edge of the <b>old</b> town&nbsp;square.<p>Short one.
<p>It is not the first time that this has been said of the animals that live in the area around here &amp; there.</p>
<aside>Related to the story of the day</aside><form><label>Name</label><input></form></div>
<div class="comments"><p>I am of the opinion that it is not true at all and that you should be ashamed of this.</p></div>
<script>var a = "<p>no</p>";</script><footer>&copy; 2020 all of the rights</footer></body></html>"""


def test_html(spark):
    want = "A title of the story The quick fox is in the wood and it was seen by all of us at the edge of the old town square. Short one. It is not the first time that this has been said of the animals that live in the area around here & there."
    assert main_text(PAGE) == want
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<article>x</article><div>" + "y " * 200)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("main_text", F.lit("mine"))
    got = [(r["page_id"], r["main_text"]) for r in extract_text(d).orderBy("page_id").collect()]
    assert got[:4] == [(1, want), (1, want), (2, ""), (3, "")]
    assert dict(got)[5].startswith("x y y")
    assert extract_text(d.limit(0)).count() == 0


def test_html_of_other_languages():
    russian = ["Вчера вечером в городе прошёл большой праздник, на который собрались тысячи жителей и гостей области.", "Организаторы обещают повторить его следующим летом, если позволят погода и средства городского бюджета."]
    polish = ["Wczoraj wieczorem odbyło się wielkie święto, na które przybyły tysiące mieszkańców oraz gości z całego województwa."] * 2
    chinese = ["昨天晚上城市里举行了盛大的节日活动，成千上万的居民和游客聚集在广场上观看表演。" * 3] * 2
    tags = "<p>" + "".join(f"<a href=/t{i}>праздник город</a> " for i in range(9)) + "</p>"
    for body in (russian, polish, chinese):
        paragraphs = f"<h1>Заголовок</h1><p>{body[0]}</p><p>{body[1]}</p>"
        want = " ".join(["Заголовок", *body])
        assert main_text(f"<body><div>{paragraphs}</div>{tags}</body>") == want
        assert main_text(f"<body><article>{paragraphs}{tags}</article></body>") == want
    short = "<p>Коротко.</p><p>Ещё короче.</p>"
    assert main_text(f"<article>{short}{tags}</article>") == "Коротко. Ещё короче."
    english = "<p>The quick fox is in the wood and it was seen by all of us at the edge of the old town square.</p>"
    junk = "<p>" + "casino poker bonus jackpot " * 5 + "</p>"
    assert "casino" not in main_text(english + junk + english * 3)
    assert russian[0] in main_text(english * 2 + f"<p>{russian[0]}</p>")


def test_html_names_and_zones():
    a = "The quick fox is in the wood and it was seen by all of us at the edge of the old town square."
    b = "It is not the first time that this has been said of the animals that live in the area around here."
    body = f"<h1>A title</h1><p>{a}</p><p>{b}</p>"
    want = f"A title {a} {b}"
    for name in ("content has-sidebar", "with-header", "no-comments", "layout-search", "elementor-widget-text"):
        assert main_text(f'<div class="{name}">{body}</div>') == want
    for name in ("article-header", "post-header", "entry-header has-banner"):
        assert main_text(f'<article><div class="{name}"><h1>A title</h1><p>By me</p></div><p>{a}</p><p>{b}</p></article>') == f"A title By me {a} {b}"
    for name in ("sidebar", "related-posts", "site-footer", "main-nav", "comment-list", "cookie-notice"):
        assert main_text(f'<div>{body}<div class="{name}"><p>{a} Not this.</p></div></div>') == want
    comments = f"<article class=comment><p>I am of the opinion that it is not true. {a}</p></article>" * 3
    assert main_text(f"<div>{body}</div>{comments}") == want
    assert main_text(f"<article>{body}</article>{comments}") == want
    cards = "<article><p>Short card</p></article>" * 3
    assert main_text(f"<div>{body}</div><div>{cards}</div>").startswith(want)
    assert main_text(f"<article>{body}</article><div><p>{a} Outside.</p><p>Not this.</p></div>") == f"{want} {a} Outside. Not this."
    assert main_text(f"<article>{body}</article><div><p>Not this.</p></div>") == want
    assert main_text(f'<div class="search">Find<main>{body}</main>it</div>') == want


def test_secrets_of_broken_and_upper_case_keys():
    import base64
    import textwrap

    inner = bytes([2, 1, 0]) + bytes([4, 129, 180]) + bytes(range(180))
    der = bytes([0x30, 0x81, len(inner)]) + inner
    ssh = b"\0\0\0\x07ssh-rsa" + b"\0\0\0\xa0" + bytes(range(160))
    find = lambda text: [(k, text[a:b]) for k, a, b in secrets.find_secrets(text) if k not in secrets.BASE_KINDS]
    for lead in ("{\"private_key\": \"", "key = b'"):
        for end in ("\\n", "\\r\\n", "\\\\n", "\\n\"\n  \"", "\r\n"):
            pem = end.join(["-----BEGIN PRIVATE KEY-----", *textwrap.wrap(base64.b64encode(der).decode(), 64), "-----END PRIVATE KEY-----"])
            assert find(f"{lead}{pem}{end}\"") == [("pem", pem)]
    for data, kind in ((der, "der"), (ssh, "sshkey")):
        for width in (64, 76):
            for end in ("\n", "\r\n", "\n    ", "\\n", "\\r\\n"):
                key = end.join(textwrap.wrap(base64.b64encode(data).decode(), width))
                assert find(f"é the key{end}{key}{end}thanks and so on") == [(kind, key)], (width, end)
        alone = base64.b64encode(data).decode()
        assert find(f'"\\n{alone}\\n"') == [(kind, alone)] and find(f"k {alone} e\n") == [(kind, alone)]
        assert find(f"0x{data.hex().upper()};") == [(kind, data.hex().upper())]
    assert [k for k, _, _ in secrets.find_secrets(der.hex().upper())] == ["der"]
    assert find("\n".join(["M" + "a" * 63] * 500)) == []


def context_of(spark, rows):
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["pii_spans"] for r in pii.find_pii(d).collect()}
    return {i: [rows[i][s["start"] : s["end"]] for s in got[i] if s["kind"] == "context"] for i in got}


def test_pii_identifiers_of_all_forms(spark):
    rows = [f"é😀 my contact is +1 (555) 010-20{i:02d} today" for i in range(10, 22)]
    unseen = ["DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "555 010 2030", "123 45 6789", "(555) 010-2030", "user@host", "4711", "gh0st", "jdoe", "X9988-77665"]
    rows += [f"é😀 my contact is {x}, ok" for x in unseen] + [f'{{"my contact is":"{unseen[-1]}"}}'] + ["my contact is the one and it is the end", "in the sun and the one"] * 2
    found = context_of(spark, rows)
    assert [found[12 + i] for i in range(len(unseen))] == [[x] for x in unseen]
    assert all(found[i] == [] for i in (*range(12), *range(len(rows) - 4, len(rows))))


def test_pii_rounds_go_on_and_unseen_values_are_no_evidence(spark):
    steps = ["first alpha", "second beta", "third gamma", "fourth delta", "fifth epsilon", "sixth zeta"]
    ids = [[f"{k}00{n}-5566{k}" for n in range(3)] for k in range(1, 7)]
    rows = [f"{steps[0]} +1 (555) 010-20{n:02d} end" for n in range(10, 13)]
    for k, values in enumerate(ids):  # values of each step follow its pattern and the next one's
        rows += [f"{steps[j]} {x} end" for x in values for j in (k, k + 1) if j < len(steps)]
    rows += [f"write to the a{i}@mail.example end" for i in range(3)] + [f"write to the 99{i}-88776 end" for i in range(9)]
    found = context_of(spark, rows)
    for i, row in enumerate(rows):
        assert found[i] == ([] if "+1" in row or "@" in row else [row.split()[-2]]), row
