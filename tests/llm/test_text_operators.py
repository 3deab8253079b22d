"""Operators that work text by text: BPE, Ogg, secrets, packing, quality, language."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import same
from strataform.llm import bpe, chunks, langid, ogg, packing, quality, queries, secret_scan
from strataform.llm.common import fold

RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
CODER = bpe.LinearBpe(RANKS, P.PATTERN)
WANT = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HF = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
texts = st.text(st.one_of(st.sampled_from(list("the ing ab'é ñ\n\t　  123!?")), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_bpe_equals_the_library_and_decodes(text):
    ids = CODER.encode(text)
    assert ids == WANT.encode_ordinary(text)
    assert CODER.decode(ids) == text.encode()
    cut = chunks.split_chunks(text)
    if cut is not None:
        assert "".join(cut) == text
        assert [i for c in cut for i in CODER.encode(c)] == ids


@settings(max_examples=200, deadline=None)
@given(texts)
def test_packing_ids_equal_tokenizers(text):
    assert np.frombuffer(packing.token_bytes(P.path("byte_bpe_50k.json"), text), "<u4").tolist() == HF.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000, "ab" * 4000 + " x", "<|endoftext|> a", "x<|endoftext|><|endoftext|>", "<|endoftext| >"])
def test_long_runs(text):
    assert CODER.encode(text) == WANT.encode_ordinary(text)
    assert np.frombuffer(packing.token_bytes(P.path("byte_bpe_50k.json"), text), "<u4").tolist() == HF.encode(text, add_special_tokens=False).ids


def test_bpe_in_spark(spark, docs, rows, none):
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    got = Counter(tuple(r) for r in bpe.bpe_digests(docs, *args).collect())
    want = Counter()
    for k, t in rows:
        ids = WANT.encode_ordinary(t)
        want[k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == want
    full = bpe.bpe_decode(bpe.bpe_encode(docs, *args), *args)
    assert full.columns == [*docs.columns, "ids", "decoded"]
    assert full.where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0
    assert bpe.bpe_digests(none, *args).count() == 0


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=70_000), st.integers(1, 3), st.sampled_from([1, 254, 255, 256, 510, 1920, 65025]))
def test_ogg_round_trip(payload, streams, packet):
    if packet == 1:
        payload = payload[:600]
    data = ogg.mux(payload, streams, packet)
    back, parts, _ = ogg.read_payload(data)
    assert back == payload and len(parts) == streams
    for s in parts.values():  # granules: the samples that end by each packet
        ends = np.cumsum([0, *(len(p) for p in s.packets[1:])])
        assert s.granules == ends.tolist()
    for flags, _, _, _, lacing, body in ogg.pages_of(data):
        assert sum(lacing) == len(body) and len(lacing) <= 255


def test_ogg_checks():
    data = ogg.mux(b"x" * 5000)
    first = next(ogg.pages_of(data))
    page = data[: 27 + len(first[4]) + len(first[5])]
    assert slow_crc(page[:22] + bytes(4) + page[26:]) == int.from_bytes(page[22:26], "little")
    for at in (30, 100, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.demux(bytes(broken))
    with pytest.raises(ogg.OggError):
        ogg.demux(data[:-10])
    with pytest.raises(ogg.OggError):
        ogg.demux(page)  # a stream without its end


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40_000), st.integers(1, 3), st.sampled_from([254, 1920, 30_000]), st.integers(0, 10**6))
def test_ogg_goes_on_after_an_unsound_page(size, streams, packet, seed):
    """One broken byte costs the packets of its page and no others; what is left keeps its granules."""
    r = np.random.default_rng(seed)
    data = ogg.mux(r.bytes(size), streams, packet)
    whole = ogg.demux(data)
    broken = bytearray(data)
    broken[int(r.integers(len(data)))] ^= 1 + int(r.integers(255))
    junk = bytes(broken) + b"OggS and more"
    with pytest.raises(ogg.OggError):
        ogg.demux(junk)
    back = ogg.demux(junk, resync=True)
    lost = 0
    for serial, s in whole.items():
        have = list(zip(s.granules, s.packets))
        kept = list(zip(back[serial].granules, back[serial].packets)) if serial in back else []
        assert [x for x in have if x in kept] == kept
        lost += len(have) - len(kept)
        assert serial not in back or len(kept) == len(have) or back[serial].gaps
    assert lost <= 257


def plain_ogg(payload, streams=2, packet=1920):
    """Pages as RFC 3533 has them, byte by byte: each stream's header on its own page, then its packets; streams take turns by page."""
    pages = []
    for s in range(streams):
        mine = [payload[a : a + packet] for a in range(0, len(payload), packet)][s::streams]
        values = [(16, 0, ogg.SAMPLES.pack(ogg.MAGIC, streams, 8, ogg.RATE), True)]
        lines, total = [[values[0]]], 0
        segments = []
        for p in mine:
            total += len(p)
            pieces = [p[i : i + 255] for i in range(0, len(p), 255)]
            if len(p) % 255 == 0:
                pieces.append(b"")
            segments += [(len(x), total, x, i == len(pieces) - 1) for i, x in enumerate(pieces)]
        lines += [segments[i : i + 255] for i in range(0, len(segments), 255)]
        own, open_ = [], False
        for number, line in enumerate(lines):
            ended = [g for _, g, _, last in line if last]
            flags = (1 if open_ else 0) | (2 if number == 0 else 0) | (4 if number == len(lines) - 1 else 0)
            head = b"OggS\0" + bytes([flags]) + (ended[-1] if ended else -1).to_bytes(8, "little", signed=True) + (s + 1).to_bytes(4, "little") + number.to_bytes(4, "little")
            rest = bytes([len(line)]) + bytes(n for n, *_ in line) + b"".join(x for _, _, x, _ in line)
            own.append(head + slow_crc(head + bytes(4) + rest).to_bytes(4, "little") + rest)
            open_ = not line[-1][3]
        pages.append(own)
    return b"".join(p[i] for i in range(max(map(len, pages))) for p in pages if i < len(p))


@pytest.mark.parametrize("size", [192, 1920, 1920 * 2, 1920 * 3 + 192, 255 * 192, 70_080])
def test_ogg_bytes_against_a_plain_writer(size):
    payload = np.random.default_rng(size).bytes(size)
    media = ogg.mux(payload)
    assert media == plain_ogg(payload)
    _, streams, rate = ogg.read_payload(media)
    x = np.frombuffer(payload, np.uint8).astype(float)
    parts = dict(p.split("=") for p in ogg.features(payload, streams, rate).split(";"))
    assert parts["streams"] == "2" and int(parts["packets"]) == 2 + -(-size // 1920) and int(parts["pages"]) == media.count(b"OggS")
    assert abs(float(parts["mean"]) - x.mean()) < 1e-5 and abs(float(parts["dev"]) - x.std()) < 1e-4
    assert sum(float(v) for v in parts["seconds"].split(",")) == pytest.approx(size / 8000, abs=1e-5)


def test_ogg_in_spark(docs, rows, none):
    got = ogg.media_digests(docs).collect()
    assert len(got) == len(rows)
    payloads = defaultdict(list)
    for k, t in rows:
        raw = t.encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        payloads[k].append((len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in payloads[r.doc_id] and r.payload_bytes % 192 == 0
    media = ogg.read_media(ogg.store_media(docs.select("doc_id", "text", "score")))
    assert media.where("media_error is not null").count() == 0
    assert ogg.read_media(media.select("doc_id", F.lit(b"junk").alias("media"))).where("media_error is null").count() == 0
    assert ogg.media_digests(none).count() == 0


def brute_secrets(t):
    any_case = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join(any_case(w).replace("_", "_?") for w in ("password", "passwd", "secret", "token", "api_key"))
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t):
        value = m[0]
        words = re.fullmatch("[A-Za-z/_=+-]+", value) and re.match("[A-Za-z]|[/_=+-]", value)
        numbers = re.fullmatch("[0-9]+([-_/][0-9]+)*", value)
        bits = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(value[i : i + 20]).values()) for i in range(len(value) - 19))
        least = next(bits for rx, bits in (("[0-9a-fA-F]+", 3.05), ("[A-Z0-9]+", 3.45), ("[a-z0-9]+", 3.45), (".*", 3.75)) if re.fullmatch(rx, value))
        if not words and not numbers and "EXAMPLE" not in value and bits >= least:
            found.append((m.start(), 3, m.end(), "entropy"))
    return sorted(found)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["0123456789abcdef", "ABCDEF0123", "abcxyz789", "ABCXYZ789", "aB3/_=-+", "ab", "a_b-", "12-/"]), st.integers(15, 70), st.integers(0, 10**6)), min_size=30, max_size=30))
def test_secrets_of_every_class(spark, made):
    """Candidates around all thresholds and lengths."""
    texts_ = ["".join(np.random.default_rng(seed).choice(list(letters), n)) for letters, n, seed in made]
    df = spark.createDataFrame([(i, f"a {t} b") for i, t in enumerate(texts_)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, secret_scan.KINDS.index(s.kind), s.end, s.kind) for s in r.secrets] for r in secret_scan.scan_secrets(df).collect()}
    assert got == {i: brute_secrets(f"a {t} b") for i, t in enumerate(texts_)}


def test_secrets(docs, rows, none):
    got = defaultdict(list)
    for r in secret_scan.secret_digests(docs).collect():
        got[r.doc_id].append(r)
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    kinds = Counter()
    for k, t in rows:
        spans = brute_secrets(t)
        kinds.update(s[3] for s in spans)
        base = [s for s in spans if s[1] < 3]
        assert (line(spans), hashlib.sha256(line(base).encode()).hexdigest(), sum(s[1] == 0 for s in spans)) in [(r.spans, r.base_sha256, r.n_assign) for r in got[k]]
    assert set(kinds) == {"assign", "access", "hex", "entropy"}
    assert secret_scan.secret_digests(none).count() == 0


def test_many_secrets_and_redaction(spark):
    text = "😀 " + "token=abcdef1 " * 700 + "end"
    df = spark.createDataFrame([(1, text, "keep"), (2, None, "keep"), (3, "clean", "keep")], "doc_id long, text string, kind string")
    done = secret_scan.scan_secrets(df).withColumn("text", secret_scan.redact("text", "secrets"))
    assert done.columns == ["doc_id", "text", "kind", "secrets"]
    got = {r.doc_id: (r.text, len(r.secrets)) for r in done.collect()}
    assert got == {1: ("😀 " + "[assign] " * 700 + "end", 700), 2: (None, 0), 3: ("clean", 0)}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, np.int64)
    plan = packing.solve(counts, 40)
    used = Counter(n for times, parts in plan for n in parts for _ in range(times))
    assert used == Counter(lengths) and all(sum(parts) <= 40 for _, parts in plan)
    if lengths:
        total, n = sum(lengths), sum(times for times, _ in plan)
        assert n >= -(-total // 40) and n <= 2 * -(-total // 40)
    keys, _, _ = packing.placement(plan)
    assert len(set(keys.tolist())) == len(keys)


def brute_complement(left, gap):
    """Whether one, two or three available lengths have that sum."""
    have = [n for n in range(1, len(left)) for _ in range(min(3, int(left[n])))]
    return any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(have, k))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=40), st.lists(st.integers(1, 24), max_size=12))
def test_index_of_sums_finds_every_complement(lengths, gaps):
    index = packing.Complements(np.bincount(lengths, minlength=25))
    for gap in gaps:
        found = index.exact(gap)
        assert (found is not None) == brute_complement(index.left, gap)
        if found:
            assert sum(found) == gap and list(found) == sorted(found, reverse=True) and len(found) <= 3
            assert all(index.left[n] >= found.count(n) for n in found)
            assert index.take(found, 1) == 1


def fewest(lengths, capacity):
    """The least number of sequences, by trying all."""
    best = len(lengths)

    def place(rest, room):
        nonlocal best
        if len(room) >= best:
            return
        if not rest:
            best = len(room)
            return
        for i in sorted({r: i for i, r in enumerate(room)}.values()):
            if room[i] >= rest[0]:
                place(rest[1:], [*room[:i], room[i] - rest[0], *room[i + 1 :]])
        place(rest[1:], [*room, capacity - rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plan_against_the_fewest(lengths):
    n = sum(times for times, _ in packing.solve(np.bincount(lengths, minlength=21), 20))
    assert n <= fewest(lengths, 20) + 1


def test_exact_complements_come_first():
    counts = np.bincount([30, 10, 25, 15, 20, 11, 9, 20], minlength=41)
    assert sum(times for times, _ in packing.solve(counts, 40)) == 4  # 30+10, 25+15, 20+20 and 11+9; or as good


def test_packing_salts_and_full_pieces(spark, monkeypatch):
    """A frequent length is ranked in many groups, and full pieces are not ranked at all."""
    monkeypatch.setattr(packing, "GROUP", 20)
    r = np.random.default_rng(0)
    rows = [(i, int(n), "mine") for i, n in enumerate([*[64] * 300, *[30] * 200, *[34] * 150, *r.integers(1, 65, 300)])]
    df = spark.createDataFrame(rows, "id long, length int, offset string").repartition(3)
    got = packing.best_fit_pack(df, 64, ["id"])
    assert got.columns == ["id", "length", "sequence_id", "offset"]
    sequences = defaultdict(list)
    for x in got.collect():
        sequences[x.sequence_id].append((x.offset, x.length))
    assert sum(map(len, sequences.values())) == len(rows)
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 64
    assert len(sequences) <= 1.02 * -(-sum(n for _, n, _ in rows) // 64) + 1


def test_packing_in_spark(docs, rows, none):
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json")).collect()
    want = Counter()
    for k, t in rows:
        ids = [*HF.encode(t, add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[k, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 2048
    assert len(sequences) <= 1.02 * -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack_documents(none, P.path("byte_bpe_50k.json")).count() == 0


def test_packing_refuses_pieces_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, 5), (2, 11)], "id long, length int")
    with pytest.raises(Exception, match="length outside"):
        packing.best_fit_pack(df, 10, ["id"])


def test_quality(spark, docs, none):
    own, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    got = quality.quality_predictions(own, labels, fold("doc_id", 3) == 1).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() >= 0.95 and held[held.quality == 0].predicted.mean() <= 0.15
    assert got.score.between(0, 1).all() and set(got.held_out) == {True, False}
    # labels of the held-out fold change nothing
    twisted = labels.withColumn("quality", F.when(fold("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.quality_predictions(own, twisted, fold("doc_id", 3) == 1).toPandas().sort_values("doc_id")
    assert np.allclose(again.score, quality.quality_predictions(own, labels, fold("doc_id", 3) == 1).toPandas().sort_values("doc_id").score)
    few = quality.quality_predictions(docs, labels, fold("doc_id", 3) == 1)
    assert few.count() == docs.count() and few.where("score is null").count() == 0
    assert quality.quality_predictions(none, labels, fold("doc_id", 3) == 1).count() == 0
    unlabelled = quality.quality_predictions(docs, labels.limit(0), fold("doc_id", 3) == 1)
    assert {r.score for r in unlabelled.collect()} == {0.5}


def test_risk_stays_non_negative_on_separable_data():
    r = np.random.default_rng(0)
    good, bad = r.normal(1.5, 1, (6000, 3)), r.normal(-1.5, 1, (3000, 3))
    model = quality.fit_nnpu(good[:3000], np.concatenate([good[3000:], bad[:1000]]), 0.75)
    assert (model.score(good[3000:]) > 0.5).mean() > 0.9 and (model.score(bad) > 0.5).mean() < 0.15


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_is_estimated_without_negatives(prior):
    r = np.random.default_rng(int(100 * prior))
    draw = lambda n, good: r.normal(1.5 if good else -1.5, 1, (n, 3))
    n = 4000
    mixed = r.permutation(np.concatenate([draw(int(n * prior), True), draw(n - int(n * prior), False)]))
    assert abs(quality.estimate_prior(draw(3000, True), mixed) - prior) < 0.06


def test_repeated_ids_count_once(spark):
    own, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("documents", "labels"))
    own = own.select("doc_id", "text")
    first = labels.where("quality = 1").select("doc_id").first()[0]
    again = own.where(F.col("doc_id") == first).crossJoin(spark.range(300)).drop("id")
    many = own.unionByName(again).unionByName(own.where(F.col("doc_id") == first).withColumn("text", F.lit("~"))).repartition(5)
    model = quality.fit_quality(own, labels, F.lit(True))
    same_ = quality.fit_quality(many, labels.unionByName(labels), F.lit(True))
    assert np.allclose(model.weights, same_.weights) and model.prior == same_.prior


def plain_score(model, text):
    """The score of one text by the words of the model's description."""
    z = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(quality.features(text), model.mean, model.scale)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip([*z, 1.0], model.weights))))


def test_scores_against_a_plain_version(spark, docs, rows):
    own, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    model = quality.fit_quality(own, labels, fold("doc_id", 3) != 1)
    got = quality.score_quality(docs.select("doc_id", "text"), model).collect()
    want = Counter((k, round(plain_score(model, t), 6)) for k, t in rows)
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == want


def plain_language(model, text):
    """Language and score of one text, word by word: script, trigram scores, and the best path by plain dynamic programming."""
    words = langid.words_of(text)
    if not words:
        return "und", 0.0
    best, paths = [0.0] * len(model.names), [[] for _ in model.names]
    for t, word in enumerate(words):
        marked = f"^{word}$"
        own = [sum(float(model.logp[langid.trigram_buckets([word])[1][i], j]) for i in range(len(marked) - 2)) for j in range(len(model.names))]
        own = [v if model.allowed[langid.script_of(word), j] else -1e9 for j, v in enumerate(own)]
        total = max(own) + math.log(sum(math.exp(v - max(own)) for v in own))
        own = [max(langid.FLOOR, v - total) for v in own]
        top = max(range(len(best)), key=lambda k: best[k])
        came = [top if t and best[top] - langid.PENALTY > best[j] else j for j in range(len(best))]
        best, paths = [(best[k] - langid.PENALTY * (k != j)) + own[j] for j, k in enumerate(came)], [[*paths[k], j] for j, k in enumerate(came)]
    path = paths[max(range(len(best)), key=lambda k: best[k])]
    letters = Counter()
    for word, k in zip(words, path, strict=True):
        letters[k] += len(word)
    return model.names[letters.most_common(1)[0][0]], max(letters.values()) / sum(letters.values())


def test_language_against_a_plain_version(spark, docs, rows):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_languages(own, F.lit(True))
    texts_ = sorted({t for _, t in rows if len(t) < 3000})
    got = list(zip(*langid.predict(model, texts_), strict=True))
    want = [plain_language(model, t) for t in texts_]
    assert sum(g[0] == w[0] for g, w in zip(got, want)) >= len(want) - 1
    assert sum(abs(g[1] - w[1]) < 1e-6 for g, w in zip(got, want)) >= 0.99 * len(want)


def test_many_languages():
    """More labels than a byte has room for, and a bound that is checked."""
    r = np.random.default_rng(1)
    rows_ = r.normal(size=(50, 300)).astype(np.float32)
    rows_[:, 290] += 20
    path = langid.viterbi([np.arange(50)], rows_, 2.0)[0]
    assert (path == 290).all()


def test_too_many_languages_are_refused(spark, monkeypatch):
    df = spark.createDataFrame([(i, "some words here", f"l{i}") for i in range(200)], "doc_id long, text string, lang string")
    assert len(langid.fit_languages(df, F.lit(True)).names) == 200
    assert set(langid.language_predictions(df, F.lit(False)).toPandas().lang_pred) <= {f"l{i}" for i in range(200)}
    monkeypatch.setattr(langid, "LANGUAGES", 100)
    with pytest.raises(ValueError, match="over 100 different languages"):
        langid.fit_languages(df, F.lit(True))


def test_language(spark, docs, none):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_predictions(own, fold("doc_id", 4) == 2).join(own.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.97 and got.score.between(0, 1).all()
    model = langid.fit_languages(own, F.lit(True))
    found = {r.doc_id: r for r in langid.detect_languages(docs, model).where("doc_id > 9000").collect()}
    assert found[9001].lang_pred == found[9002].lang_pred == "und" and found[9002].score == 0 and found[9001].lang_spans == []
    assert langid.language_predictions(none, fold("doc_id", 4) == 2).count() == 0
    assert {r.lang_pred for r in langid.language_predictions(docs.where("doc_id = 9001"), fold("doc_id", 4) == 2).collect()} == {"und"}


def test_mixed_language_spans(spark):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_languages(own, F.lit(True))
    take = {r.lang: r.text for r in own.where("n_chars between 300 and 900").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = take["en"] + " " + take["fr"]
    spans = langid.spans_of(model, mixed)
    assert {s[2] for s in spans} >= {"en", "fr"} and len(spans) <= 8
    assert all(a < b for a, b, _ in spans)


def test_viterbi_against_brute_force():
    r = np.random.default_rng(1)
    rows = r.normal(size=(30, 3)).astype(np.float32) * 3
    ids = [r.integers(0, 30, n) for n in (1, 2, 4, 6)]
    for x, path in zip(ids, langid.viterbi(ids, rows, 2.0), strict=True):
        cost = lambda p: sum(rows[i, k] for i, k in zip(x, p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert abs(cost(path) - max(cost(p) for p in itertools.product(range(3), repeat=len(x)))) < 1e-4


def test_scripts_narrow_candidates():
    names = [langid.SCRIPT_NAMES[langid.script_of(w)] for w in ("abc", "где", "漢字", "한글", "かな", "ελ", "ﻋ", "𠀀")]
    assert names == ["latin", "cyrillic", "han", "hangul", "kana", "greek", "arabic", "han"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    same(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
