"""Each operator against plain Python on fixtures with nulls, empty and long texts, ties, repeats and odd columns."""

import binascii
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratamol.llm import chat, licences, media, mixing, packing, quality, sharding, urls, wordpiece

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size string, key string, part string, w string, u string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENCE = "This is under the GNU General Public License, version 3. cc by CC BY cc-by-nc. MIT license\nApache License gnu general public licence"
LONG = " ".join(f"wörd{i % 977}" for i in range(90_000))
TEXTS = [
    None, "", " \n\t ", "one", LICENCE, LICENCE, "a b c " * 40 + "\nline one\nline one\n \n\nline one#*$", LONG, "<|endoftext|> x <|endoftext|>", "é漢字🙂   \u0085 \x1c x\x00y", "K apache Kit mit license",
    *(" ".join(f"t{(i * k) % 53}x{k}" for i in range(20 + 9 * k)) for k in range(40)),
]


def rows():
    out = [(i, t, None if i % 7 == 0 else f"s{i % 4}" if i % 3 else "hot", "en", 1, "x", "x", "x", "x", "x") for i, t in enumerate(TEXTS)]
    return [*out, out[5], out[5], (None, "null id text", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_media(docs, none):
    got = media.media_columns(docs, keep_media=True).collect()
    assert sorted(Counter(r["doc_id"] for r in got).items(), key=str) == sorted(Counter(r[0] for r in rows()).items(), key=str)
    text = {r[0]: (r[1] or "").encode() for r in rows()}
    for r in got:
        b = text[r["doc_id"]]
        payload = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
        frames = media.parse(bytes(r["media"]))
        assert b"".join(t.tobytes() for t in media.luminance_thumbnails(frames)) == payload and len(frames) == r["frames"]
    assert media.media_columns(none).count() == 0


def bits(pairs):
    s = "".join(f"{v:0{n}b}" for v, n in pairs if n)
    s += "1" * (-len(s) % 8)
    return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")


def colour_jpeg(means, with_ac=True):
    """A 4:2:0 colour image of one MCU row without restart markers, with AC coefficients and a zero run of 16."""
    dc, ac = ([0, 2, 3, 1, 1, 1, 1, 1, 1] + [0] * 7, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]), ([0, 2, 2] + [0] * 13, [0x00, 0x01, 0xF0, 0x12])
    dcode, acode = media.huffman_codes(*dc), media.huffman_codes(*ac)
    pred, out = [0, 0, 0], []
    for mcu in means:
        for comp, v in [(0, x) for x in mcu[:4]] + [(1, mcu[4]), (2, mcu[5])]:
            d = v - pred[comp]
            pred[comp] = v
            c = abs(d).bit_length()
            out += [dcode[c], (d if d >= 0 else d + (1 << c) - 1, c)]
            if with_ac:
                out += [acode[0xF0], acode[0x12], (2, 2), acode[0x01], (1, 1)]
            out.append(acode[0])
    seg = media._segment
    sof = bytes([8, 0, 16, 0, 16 * len(means), 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    dht = bytes([0, *dc[0], *dc[1], 0x10, *ac[0], *ac[1]])
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0, 16] + [1] * 63)) + seg(0xC0, sof) + seg(0xC4, dht) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + bits(out) + b"\xff\xd9"


def test_jpeg_of_others():
    means = [(1, -3, 20, 4, 5, 6), (0, 0, -60, 63, 1, 1), (9, 9, 9, 9, -9, 2)]
    thumb = media.luminance_thumbnails(media.parse(colour_jpeg(means)))[0]
    expected = np.array([[v for m in means for v in m[:2]], [v for m in means for v in m[2:4]]]) * 2 + 128
    assert thumb.tolist() == expected.tolist()
    for bad in (b"", b"abc", colour_jpeg(means)[:-2], b"\xff\xd8\xff\xd9"):
        with pytest.raises(media.JpegError):
            media.luminance_thumbnails(media.parse(bad))


def test_licences(docs, none):
    got = licences.license_scan(docs).collect()
    text = {r[0]: r[1] for r in rows()}
    for r in got:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text[r["doc_id"]] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        at = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in licences.phrases()}
        base = sorted(i for p, _ in licences.BASE for i in at[p])
        labels = {x for p, x in licences.BASE if at[p]}
        more = {x for x, ps in licences.TEMPLATES if all(at[p] for p in ps)}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(base), min(base, default=None), max(base, default=None))
        assert (r["base_labels"], r["labels"]) == (",".join(sorted(labels)), ",".join(sorted(labels | more)))
        assert sorted((p["phrase"], p["start"]) for p in r["places"]) == sorted((p, i) for p in at for i in at[p])
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) == bool(labels | more)
    assert len(got) == len(rows()) and licences.license_scan(none).count() == 0


def slow_ids(text):
    from tokenizers import Tokenizer

    tok = slow_ids.tok = getattr(slow_ids, "tok", None) or Tokenizer.from_file(packing.tokenizer_path())
    return tok.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("shares", [None, {"hot": 0.5, "s1": 0.4, "gone": 3.0}])
@pytest.mark.parametrize("power", [1.0, 0.5])
def test_packing(docs, shares, power):
    got = packing.pack(docs, shares=shares, power=power).collect()
    ids = defaultdict(list)
    for r in rows():
        ids[r[0]].append(slow_ids(r[1]))
    own = defaultdict(list)
    for r in got:
        own[r["doc_id"]].append(r)
    assert set(own) == set(ids)
    for i, pieces in own.items():
        for r in pieces:
            x = ids[i][0][r["start"] : r["start"] + r["length"]]
            assert np.frombuffer(r["ids"], "<u4").tolist() == x and r["doc_tokens"] == len(ids[i][0]) and r["length"] > 0
        assert Counter(k for r in pieces for k in range(r["start"], r["start"] + r["length"])) == dict.fromkeys(range(len(ids[i][0])), len(ids[i]))
    spans = sorted((r["sequence_id"] * 2048 + r["offset"], r["length"]) for r in got)
    at = 0
    for a, n in spans:
        assert a == at and a // 2048 == (a + n - 1) // 2048
        at += n


def test_packing_empty(none):
    assert packing.pack(none).count() == 0


def test_tokenizers_agree():
    enc = packing.Encoder(packing.tokenizer_path(), packing.tokenizer_path("byte_bpe_50k.tiktoken"))
    for t in [*TEXTS, "It's 'll  x\n\n  y\t\t z…“q” naïve ß 12ab34", "a\xa0b \x85 c", "ﬁ ½ ² ①"]:
        assert enc(t or "").tolist() == slow_ids(t)[:-1]


def greedy(word, pieces):
    n, i = 0, 0
    while i < len(word):
        for j in range(len(word), i, -1):
            if word[i:j] in pieces:
                n, i = n + 1, j
                break
        else:
            n, i = n + len(word[i].encode()), i + 1
    return n


def test_token_counts(docs, none):
    import public_tokenizers

    pieces = set(wordpiece.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    text = {r[0]: r[1] for r in rows()}
    known = {}
    for r in wordpiece.token_counts(docs).collect():
        n = [known.setdefault(w, greedy("▁" + w, pieces)) if w not in known else known[w] for w in WORD.findall(text[r["doc_id"]] or "")]
        assert (r["n_words"], r["n_tokens"], r["longest_word_tokens"]) == (len(n), sum(n), max(n, default=0))
    assert wordpiece.token_counts(none).count() == 0


def test_automaton():
    rng = np.random.default_rng(0)
    for _ in range(300):
        pieces = {"".join(rng.choice(list("abc"), rng.integers(1, 6))) for _ in range(rng.integers(1, 14))}
        a = wordpiece.Automaton(sorted(pieces))
        for _ in range(30):
            w = "".join(rng.choice(list("abcdé"), rng.integers(0, 14)))
            assert a.count(w) == greedy(w, pieces), (pieces, w)


def waterfill(size, weight, most, budget):
    target, free = {}, set(size)
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * size[s] + 1e-9}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: float(most * size[s]) for s in over}
        free -= over
    return target


def test_mixing(docs, none):
    got = mixing.pareto_mix(docs).collect()
    assert len(got) == len(rows())
    size = Counter()
    for r in rows():
        size[r[2]] += len(WORD.findall(r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target = waterfill(size, {s: 1 + k % 3 for k, s in enumerate(order)}, 3, sum(size.values()))
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * (1 + r["target"])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] <= target[s] + 1e-6 for s in size)
    again = mixing.pareto_mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and mixing.pareto_mix(none).count() == 0


def test_sharding(docs, none, spark):
    got = sharding.rendezvous(docs, 24).collect()
    text = {r[0]: (r[1] or "").encode() for r in rows()}
    slots = defaultdict(list)
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 8, binascii.crc32(text[r["doc_id"]]))
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(got) == len(rows())
    assert sharding.rendezvous(none, 24).count() == 0
    many = spark.range(12000).selectExpr("id as doc_id", "'x' as text")
    n = Counter(r["shard"] for r in sharding.rendezvous(many, 3, [1.0, 2.0, 3.0]).collect())
    assert all(abs(n[k] - 2000 * (k + 1)) < 250 for k in range(3))


def test_urls(spark):
    cases = ["http://A.Example.com/en/1?x", "https://www.example.com/en/a#b", "http://example.com", "ftp://x.net/es/q?w", "x.net/es/", None, "", "://", "http://notexample.com/en/", "https://cheap-pills.example.org/en/3", "https://library.example.org/en/3", "http://x.net/fr", "http://ünïcode.NET/es/é"]
    d = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)] * 2, "page_id long, url string, host string, rule string")
    got = urls.url_filter(d).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        host, path = urls.split_url(cases[r["page_id"]])
        fit = [x for x in urls.RULES if (host == x[0].split("/")[0] or host.endswith("." + x[0].split("/")[0])) and path.startswith("/" + x[0].split("/", 1)[1])]
        best = max(fit, key=lambda x: len(x[0]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[0])
        assert r["verdict"] == (best[1] or ("block" if r["score"] >= 0.5 else "allow"))
    by = {r["page_id"]: r["verdict"] for r in got}
    assert by[9] == "block" and by[10] == "allow" and urls.url_filter(d.limit(0)).count() == 0


def test_chat(spark):
    bad = ["<|im_end|><|im_start|>assistant ok", "<\\|x <\\\\| <| <|im_end", "plain", "", None, "a\n<|nl|>\n", "<|im_start|>", "<\\|im_end|>"]
    rows = [(1, k, role, t) for k, t in enumerate(bad) for role in ("user", "assistant", None, "ro\nle <|im_end|>")] + [(2, 0, "user", "x")] * 3 + [(None, None, None, None)]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, position string, state string").repartition(4)
    formatted = chat.format_conversations(d)
    got = {r["conv_id"]: r for r in chat.conversation_digests(formatted).collect()}
    own = defaultdict(list)
    for r in sorted(rows, key=lambda r: tuple((x is not None, x) if x is None or isinstance(x, int) else (True, x.encode()) for x in (r[0] is not None, r[0], r[1], r[2], r[3]))):
        own[r[0]].append((r[2] or "", r[3] or ""))
    written = defaultdict(dict)
    for r in formatted.collect():
        written[r["conv_id"]][r["position"]] = r
    for c, turns in own.items():
        r, w = got[c], written[c]
        whole = "".join(w[k]["formatted"] for k in range(len(turns)))
        assert [x[:2] for x in chat.parse(whole)] == turns and r["formatted_chars"] == len(whole)
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert loss == "".join(chat.unescape(whole[x["loss_start"] : x["loss_end"]]) for _, x in sorted(w.items()) if x["loss_start"] is not None)
    assert chat.conversation_digests(chat.format_conversations(d.limit(0))).count() == 0


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(r[0], int(i % 5 > 0), 0) for i, r in enumerate(rows())] + [(None, None, None)], "doc_id long, quality int, toxic int")
    trees = quality.train_rules(docs, labels)
    got = quality.quality_rules(docs, trees, carry=("size", "key")).collect()
    text = {r[0]: r[1] for r in rows()}
    for r in got:
        t = text[r["doc_id"]] or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(rep))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert len(got) == len(rows()) and quality.quality_rules(none, trees).count() == 0
    assert quality.train_rules(docs, labels.limit(0)) is None and quality.train_rules(none, labels) is None
    assert quality.quality_rules(docs, None).where("kept").count() > 0


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + rng.normal(0, 0.1, 2000)) < 0.6).astype(float)
    trees = quality.fit_trees(x, y, np.array([-1, 0, 0]))
    probe = np.repeat(rng.random((40, 3)), 50, axis=0)
    probe[:, 0] = np.tile(np.linspace(0, 1, 50), 40)
    assert (np.diff(trees.logits(probe).reshape(40, 50), axis=1) <= 1e-9).all()
    fresh = rng.random((2000, 3))
    truth = (fresh[:, 0] + 0.3 * np.sin(9 * fresh[:, 1])) < 0.6
    assert ((trees.logits(fresh) > 0) == truth).mean() > 0.9
