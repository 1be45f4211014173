import hashlib
import io
import random
import re
import struct
import zlib

import numpy as np
import pytest

from recordloom.llm import bpe, licenses, media, mixing, pretokens, token_counts, toxicity
from tests.llm.conftest import ROWS

TEXTS = [(r[0], r[1] or "") for r in ROWS]
RANKS = pretokens.load_ranks(pretokens.default_path())
key = lambda rows: sorted(rows, key=str)


def reference_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("name", ["plain", "extra", "empty"])
def test_bpe_equals_the_library(tables, name):
    encoding = reference_encoding()
    want = []
    for id_, text in TEXTS if name != "empty" else []:
        found = encoding.encode_ordinary(text)
        want.append((id_, len(found), hashlib.sha256(struct.pack(f"<{len(found)}I", *found)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    rows = bpe.digests(bpe.encode(tables[name])).collect()
    assert key((r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == key(want)
    rows = bpe.encode_digests(tables[name], chars=10, words=3).collect()  # many blocks
    assert key((r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == key(want)


def test_decoding_gives_the_texts(tables):
    rows = bpe.decode(bpe.encode(tables["plain"])).collect()
    assert key((r.id, r.text) for r in rows) == key(TEXTS)


def test_heap_and_library_agree():
    encoding, merges, rng = reference_encoding(), bpe.pairs(RANKS), random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("aeiotrnsßé中 ") for _ in range(rng.randrange(1, 60))).strip() or "x"
        found = bpe.ids(bpe.heap_merges(word.encode(), merges), np.array([RANKS[bytes([i])] for i in range(256)], np.uint32)).tolist()
        assert bpe.decode_ids(found, RANKS) == word.encode()
        if re.fullmatch(r"\w+", word) and word.isalpha():
            assert found == encoding.encode_ordinary(word)


def test_splitter_takes_the_pattern():
    import public_tokenizers
    import regex

    split = pretokens.splitter(public_tokenizers.PATTERN)
    rng = random.Random(3)
    points = [i for a, b in pretokens.LATIN for i in range(a, b)]
    mixed = ["".join(map(chr, rng.choices([*points, 32, 39, 0x3000, 0x1D7D8], k=400))) for _ in range(50)]
    for text in ["don't  stop\n\n 123 !!", "été  où　\x85 x", "\x1c\x1d a\x1f", "tab\tend  ", "".join(map(chr, points)), "a²½ \xa0–x €5 ª", *mixed]:
        assert split(text) == regex.findall(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), text)


def best_count(word, cost):
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        best.append(min((best[s][0] + cost[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in cost))
    return best[-1][1]


@pytest.mark.parametrize("name", ["plain", "extra", "empty"])
def test_token_counts_against_brute_force(tables, name):
    cost, split = token_counts.costs(RANKS), pretokens.splitter(pretokens.default_pattern())
    memo = {}
    count = lambda w: memo.setdefault(w, token_counts.trie_counts([w], cost)[w] if len(w) > 200 else best_count(w, cost))
    want = [(id_, sum(count(w.encode()) for w in split(text)), len(split(text))) for id_, text in TEXTS] if name != "empty" else []
    rows = token_counts.count_tokens(tables[name], block=100).collect()
    assert key((r.id, r.n_tokens, r.n_words) for r in rows) == key(want)


def test_trie_shares_prefixes():
    cost = token_counts.costs(RANKS)
    words = [w.encode() for w in ["the", "then", "them", "theme", "zß", "中文", " a", ""]]
    assert token_counts.trie_counts(words, cost) == {w: best_count(w, cost) for w in words}


@pytest.mark.parametrize("name", ["plain", "extra", "empty"])
def test_license_places_against_brute_force(tables, name):
    want = []
    for id_, text in TEXTS if name != "empty" else []:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        want.append((id_, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    rows = licenses.summaries(licenses.scan_licenses(tables[name])).collect()
    assert key((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == key(want)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)


def test_license_expressions():
    parse = lambda x: sorted(map(sorted, licenses.evaluate(licenses.parse_expression(x)[0])))
    assert parse("MIT OR Apache-2.0 AND BSD-3-Clause") == [["apache-2.0", "bsd-3-clause"], ["mit"]]
    assert parse("(MIT OR Apache-2.0) AND BSD-3-Clause") == [["apache-2.0", "bsd-3-clause"], ["bsd-3-clause", "mit"]]
    assert parse("GPL-2.0-only WITH Classpath-exception-2.0") == [["gpl-2.0-only-with-classpath-exception-2.0"]]
    assert licenses.parse_expression("MIT AND")[1] is False and licenses.parse_expression("(MIT")[1] is False and licenses.parse_expression("")[1] is False
    found = licenses.scan(b"# SPDX-License-Identifier: (MIT OR GPL-2.0-only)\nx", licenses._automaton())
    assert found == (10, [("expression", "gpl-2.0-only", 0, 3), ("expression", "mit", 0, 3)], 0.5)
    assert licenses.scan("é under the MIT\n\nLicense under the mit license".encode(), licenses._automaton()) == (9, [("base", "mit", 1, 4), ("base", "mit", 5, 4)], 1.0)
    assert licenses.scan(b"spdx license identifier", licenses._automaton()) == (3, [], 0.0)


def test_license_operators_and_many_tags():
    automaton = licenses._automaton()
    both, either = (licenses.scan(b"SPDX-License-Identifier: MIT %s GPL-2.0-only" % op, automaton) for op in (b"AND", b"OR"))
    assert [f[0] for f in both[1]] == ["required"] * 2 and [f[0] for f in either[1]] == ["expression"] * 2 and (both[2], either[2]) == (1.0, 0.5)
    n, found, score = licenses.scan(b"SPDX-License-Identifier: MIT\n" * 100_000, automaton)  # in linear time
    assert n == 400_000 and [f[2] for f in found] == list(range(0, 400_000, 4)) and score == 1.0
    rng = random.Random(1)

    def text(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice("abcdef")
        if rng.random() < 0.15:
            return f"({text(depth - 1)}) with {rng.choice('xyz')}"
        return f"({text(depth - 1)} {rng.choice(['or', 'and'])} {text(depth - 1)})"

    for _ in range(500):
        postfix = licenses.parse_expression(text(4))[0]
        ways = licenses.evaluate(postfix)
        assert licenses.decide(postfix) == (frozenset().union(*ways), frozenset.intersection(*ways))
    line = " AND ".join(f"(a{i} OR b{i})" for i in range(2000))
    names, needed = licenses.decide(licenses.parse_expression(line)[0])
    assert len(names) == 4000 and not needed and licenses.decide([]) == (frozenset(), frozenset())


def test_licenses_of_very_long_lines():
    import time

    automaton = licenses._automaton()
    line = lambda joined, n: b"SPDX-License-Identifier: " + joined.join(b"LicenseRef-%d" % i for i in range(n))
    began = time.process_time()
    n_words, findings, score = licenses.scan(b"SPDX-License-Identifier: MIT " * 100_000, automaton)
    assert (n_words, len(findings), score) == (400_000, 100_000, 1.0) and {f[:2] for f in findings} == {("required", "mit")}
    assert [f[2] for f in findings] == [*range(0, 400_000, 4)]
    for joined, kind in ((b" AND ", "required"), (b" OR ", "expression")):
        findings = licenses.scan(line(joined, 100_000), automaton)[1]
        assert len(findings) == 100_000 and {f[0] for f in findings} == {kind}
    assert time.process_time() - began < 60
    assert licenses.scan(b"SPDX-License-Identifier: MIT AND SPDX-License-Identifier: Apache-2.0", automaton)[1] == [("required", "mit", 0, 3), ("required", "apache-2", 5, 3)]


def plain_scan(text):
    """Places of all phrases by comparing words, expressions by their listed alternatives."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = [(m[0], m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    found, pieces, broken = [], [], False
    for kind, phrases in (("notice", licenses.NOTICES), ("base", licenses.BASE), ("tag", {licenses.TAG: ""})):
        for phrase, label in phrases.items():
            parts = phrase.split()
            for i in range(len(words) - len(parts) + 1):
                if [w for w, _ in words[i : i + len(parts)]] != parts:
                    continue
                if kind != "tag":
                    found.append((kind, label, i, len(parts)))
                    pieces.append({label})
                    continue
                rest = text[words[i + len(parts) - 1][1] :].split("\n")[0].lstrip(" \t\r\x0b\x0c")
                if rest[:1] != ":":
                    continue
                postfix, whole = licenses.parse_expression(rest[1:])
                ways = [{licenses.label_of(x) for x in way} for way in licenses.evaluate(postfix)]
                names = set().union(*ways)
                broken |= not whole or None in names
                needed = set.intersection(*ways) - {None} if ways else set()
                found += [("required" if x in needed else "expression", x, i, len(parts)) for x in names - {None}]
                pieces += [needed] * bool(needed) + [{x} for x in names - needed - {None}]
    best = max((sum(x in p for p in pieces) for p in pieces for x in p), default=0)
    return len(words), sorted(found), best / len(pieces) / (1 + broken) if pieces else 0.0


def test_license_scan_against_plain_search():
    rng = random.Random(8)
    names = ["MIT", "GPL-2.0-only", "apache-2.0", "unknown-1", "0BSD", "CC0-1.0"]
    parts = [*licenses.BASE, *licenses.NOTICES, "Under the MIT License", "SPDX-License-Identifier:", "spdx license identifier", ":", "\n", "é", "x", "(", ")", "AND", "or", "With", *names]
    automaton = licenses._automaton()
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", "\n", "-"]) for _ in range(rng.randrange(25)))
        expression = " ".join(x for _ in range(rng.randrange(1, 4)) for x in (rng.choice(names), rng.choice(["OR", "AND"])))
        text += f"\n// SPDX-License-Identifier: {expression.rsplit(' ', 1)[0]}\n" if rng.random() < 0.7 else ""
        n, found, score = licenses.scan(text.encode(), automaton)
        want = plain_scan(text)
        assert (n, sorted(found)) == want[:2] and abs(score - want[2]) < 1e-9, text


def plain_hash(image):
    """8 x 9 cells' means by the overlap of each sample with each cell."""
    height, width = image.shape

    def share(size, cells, cell, i):
        return max(0.0, min(i + 1, size * (cell + 1) / cells) - max(i, size * cell / cells))

    means = np.array([[sum(share(height, 8, r, i) * share(width, 9, c, j) * float(image[i, j]) for i in range(height) for j in range(width)) / (height * width / 72) for c in range(9)] for r in range(8)])
    bits = np.rint(means * 256).astype(int)
    return np.packbits(bits[:, 1:] > bits[:, :-1]).tobytes().hex()


def test_difference_hash_against_overlaps():
    rng = np.random.default_rng(4)
    for height in (1, 2, 3, 7, 8, 20):
        image = rng.integers(0, 256, (height, 64), dtype=np.uint8)
        assert media.difference_hash(image) == plain_hash(image)


@pytest.mark.parametrize("name", ["plain", "extra", "empty"])
def test_media_round_trip(tables, name):
    want = []
    for id_, text in TEXTS if name != "empty" else []:
        data = text.encode()
        payload = data + bytes(64 if not data else -len(data) % 64)
        want.append((id_, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    rows = media.media_features(media.store_texts(tables[name])).collect()
    for r in rows:  # the stored form: a header, then the payload, rows of long ones from the bottom up
        payload = next(p for p in (media.pad(t.encode()) for i, t in TEXTS if i == r.id) if hashlib.sha256(p).hexdigest() == r.payload_sha256)
        stored = media.encode_bmp(payload) if len(payload) >= media.BMP_FROM else b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and (len(payload) < media.BMP_FROM or stored[1078:][-64:] == payload[:64])
    assert key((r.id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == key(want)
    tiles = media.store_tiles(media.media_features(media.store_texts(tables[name])))
    stored = {(r.id, r.media_sha256): np.load(io.BytesIO(r.tile)) for r in tiles.collect()}
    back = media.tile_digests(tiles).collect()
    assert len(back) == len(rows) and all(t.shape == media.TILE and t.dtype == np.uint8 for t in stored.values())
    assert all((hashlib.sha256(t.tobytes()).hexdigest(), float(t.mean())) == (r.tile_sha256, r.tile_mean) for r in back for t in [stored[r.id, r.media_sha256]])


def test_image_formats():
    image = np.arange(24, dtype=np.uint8).reshape(4, 6)
    assert (media.decode(b"P5 # note\n6 4\n255\n" + image.tobytes()) == image).all()
    assert (media.decode(b"P2\n6 4\n255\n" + " ".join(map(str, image.ravel())).encode()) == image).all()
    assert (media.decode(b"P5\n6 4\n65535\n" + image.astype(">u2").tobytes()) == image).all()
    assert media.decode(b"P1\n3 1\n010").tolist() == [[1, 0, 1]] and media.decode(b"P4\n3 1\n\x40").tolist() == [[1, 0, 1]]
    colour = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    assert (media.decode(b"P6\n2 2\n255\n" + colour.tobytes()) == colour).all()
    rows = b"".join(r[:, ::-1].tobytes() + bytes(2) for r in colour[::-1])
    assert (media.decode(b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows) == colour).all()
    data = bytes(range(256)) * 70
    assert media.encode(data)[:2] == b"BM" and media.encode(data[:64])[:2] == b"P5"
    assert media.decode(media.encode_bmp(data)).tobytes() == media.decode(media.encode_pgm(data)).tobytes() == data
    assert media.difference_hash(media.decode(media.encode_bmp(data))) == media.difference_hash(media.decode(media.encode_pgm(data)))
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")
    assert (np.load(__import__("io").BytesIO(media.npy(image))) == image).all()


def test_area_resize_keeps_means():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 255, (13, 7)).astype(float)
    assert np.allclose(media.area_resize(image, 13, 7), image)
    assert np.allclose(media.area_resize(image, 1, 1), image.mean())
    big = np.kron(image, np.ones((4, 6)))
    assert np.allclose(media.area_resize(big, 13, 7), image)


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    out, open_, left = {}, set(sizes), share * sum(sizes.values())
    while open_:
        total = sum(w[k] for k in open_)
        over = [k for k in open_ if left * w[k] / total > most * sizes[k]]
        for k in over or list(open_):
            out[k] = most * sizes[k] if over else left * w[k] / total
            open_.discard(k)
        if over:
            left -= sum(out[k] for k in over)
    return out


@pytest.mark.parametrize("name", ["plain", "extra", "empty"])
def test_mix_targets_and_totals(tables, name):
    rows = mixing.mix(tables[name]).collect()
    if name == "empty":
        assert not rows
        return
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in ROWS:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    want = plain_targets(sizes)
    assert sorted((str(r.id), r.size) for r in rows) == sorted((str(r[0]), words(r[1])) for r in ROWS)
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in rows)
    assert {round(r.target, 6) for r in rows} == {round(x, 6) for x in want.values()}
    again = mixing.mix(tables[name]).collect()
    assert sorted((str(r.id), r.taken) for r in rows) == sorted((str(r.id), r.taken) for r in again)
    out = mixing.apply_mix(tables[name])
    assert out.columns == tables[name].columns and out.count() == sum(r.copies for r in rows)


def test_mix_balances_many_blocks(spark, tmp_path):
    rng = random.Random(4)
    data = [(i, "w " * rng.randrange(1, 60), f"s{0 if i % 3 else i % 5}") for i in range(3000)]
    spark.createDataFrame(data, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/d")
    rows = mixing.mix(spark.read.parquet(f"{tmp_path}/d"), block=64).collect()
    sources = {i: s for i, _, s in data}
    taken, goal = {}, {}
    for r in rows:
        taken[sources[r.id]] = taken.get(sources[r.id], 0) + r.taken
        goal[sources[r.id]] = r.target
    assert all(abs(taken[s] - goal[s]) <= 60 for s in goal)


def test_rows_without_ids_are_dealt_to_all_blocks(spark, tmp_path):
    data = [(None, "a b c", "s0" if i % 3 else "s1") for i in range(6000)]
    spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4).write.parquet(f"{tmp_path}/d")
    dealt, extra = mixing._plan(spark.read.parquet(f"{tmp_path}/d"), "doc_id", "text", "source", (1.0, 3.0), 1.5, 2.0, 256)
    goal = {r.source: (r.target, r.whole, r.n) for r in dealt.select("source", "target", "whole", "n").distinct().collect()}
    once = {r.source: r["count"] for r in dealt.join(extra, mixing.ROW).groupBy("source").count().collect()}
    assert all(abs(3 * (whole * n + once.get(s, 0)) - target) <= 3 for s, (target, whole, n) in goal.items())
    blocks = dealt.selectExpr(f"pmod(shiftrightunsigned(xxhash64(id, size, print, {mixing.ROW}), 20), 16) AS b").groupBy("b").count().collect()
    assert max(r["count"] for r in blocks) < 2 * min(r["count"] for r in blocks)


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 500, 200).astype(float)
    p = np.full(200, 0.3)
    mean = np.zeros(200)
    for seed in range(200):
        flown = mixing.flight(p, size, np.random.default_rng(seed).random(200))
        assert ((flown > 0) & (flown < 1)).sum() <= 2
        assert abs(flown.sum() - p.sum()) < 1e-6 and abs((flown * size).sum() - (p * size).sum()) < 1e-3
        mean += flown / 200
    assert abs(mean.mean() - 0.3) < 1e-6 and np.abs(mean - 0.3).max() < 0.2


@pytest.mark.parametrize("name", ["plain", "extra", "empty"])
def test_toxicity_rows(spark, tables, name):
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1), (9, 0, None), (9, 0, 0)], "doc_id long, quality int, toxic int")
    for grammar in (toxicity.fit(tables[name], labels), toxicity.Grammar({}, dict.fromkeys(toxicity.INSULTS, 3.0))):
        rows = toxicity.score(tables[name], grammar).collect()
        assert len(rows) == (0 if name == "empty" else len(ROWS)) and all(0 <= r.score <= 1 for r in rows)
        kept = toxicity.drop_toxic(tables[name], grammar)
        assert kept.columns == tables[name].columns and kept.count() == sum(r.score < toxicity.THRESHOLD for r in rows)


def test_grammar_composes_its_transducers():
    g = toxicity.Grammar({"lowei": 2.0}, {"idiot": 3.0})
    assert g.weigh("you idiot") > g.weigh("idiot") > g.weigh("not an idiot") > 0
    assert g.weigh("he said idiot") < g.weigh("idiot") and g.weigh("idiot you") > g.weigh("idiot")
    assert g.weigh("loweichen") == 2.0 and g.weigh("lowei") == 0  # a beginning is shorter than its word
    assert g.weigh("kill you") > 0 and g.weigh("kill the process") == 0 and g.weigh("you. kill") == 0
    assert g.weigh("") == 0 and g.weigh("a clean sentence about nothing") == 0
    assert g.weigh("IDIOT!") == g.weigh("idiot")


def plain_clause(symbols):
    """The clauses' weight by one loop with counters."""
    total, negation, target, report, threat, last = 0.0, 0, 0, False, 0.0, 0.0
    for kind, weight in symbols:
        value = weight * (toxicity.NEGATED if negation else 1) * (toxicity.REPORTED if report else 1)
        if kind == "target":
            total += last * (toxicity.WITH_TARGET - 1) + threat
            last = threat = 0.0
        elif kind == "threat":
            value *= toxicity.THREAT_WEIGHT
            total, threat = (total + value, threat) if target else (total, value)
        elif kind == "insult":
            total += value * (toxicity.WITH_TARGET if target else 1)
            last = 0.0 if target else value
        report |= kind == "report"
        negation = toxicity.REACH if kind == "negation" else max(0, negation - 1)
        target = toxicity.REACH if kind == "target" else max(0, target - 1)
    return total


def test_composition_against_counters():
    rng = random.Random(5)
    parts = [toxicity.insult_transducer(), toxicity.threat_transducer(), toxicity.negation_transducer(), toxicity.report_transducer(), toxicity.target_transducer()]
    whole = toxicity.composed()
    assert len({s for s, _ in whole.arcs}) > 50
    for _ in range(3000):
        symbols = [(c, rng.choice([1.0, 2.5]) if c == "insult" else 1.0) for c in rng.choices(toxicity.CLASSES, [3, 2, 3, 2, 1, 4], k=rng.randrange(14))]
        assert abs(whole.weigh(symbols) - plain_clause(symbols)) < 1e-9
        rng.shuffle(parts)  # each only multiplies, so their order is free
        other = parts[0].compose(parts[1]).compose(parts[2]).compose(parts[3]).compose(parts[4]) if rng.random() < 0.01 else whole
        assert abs(other.weigh(symbols) - whole.weigh(symbols)) < 1e-9


def test_matched_clauses(spark):
    g = toxicity.Grammar({}, {"idiot": 3.0})
    df = spark.createDataFrame([(1, "Fine. You IDIOT! ok\nnot an idiot"), (2, None)], "doc_id long, text string")
    rows = {r.id: r.clauses for r in toxicity.matched_clauses(df, g).collect()}
    assert [(c.start, c.text) for c in rows[1]] == [(5, " You IDIOT"), (20, "not an idiot")] and rows[1][0].weight > rows[1][1].weight and rows[2] == []


def test_coefficients_of_many_separable_rows():
    rng = np.random.default_rng(0)
    y = (rng.random(20_000) < 0.3).astype(float)
    x = np.c_[np.where(y, rng.uniform(1.5, 5, 20_000), rng.exponential(0.05, 20_000)), np.where(y, rng.uniform(1, 4, 20_000), rng.exponential(0.3, 20_000))]
    bias, slope, rate = toxicity._logistic(x, y)
    p = 1 / (1 + np.exp(-(bias + x @ [slope, rate])))
    assert ((p >= 0.7) == y).mean() > 0.999


def test_toxicity_on_labelled_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = {r.id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [(rows[r.doc_id] >= toxicity.THRESHOLD, r.toxic) for r in labels.collect() if r.doc_id in rows and toxicity.held_out(r.doc_id)]
    hits = sum(p and y for p, y in held)
    assert hits / sum(y for _, y in held) >= 0.88 and hits / sum(p for p, _ in held) >= 0.95
