"""Near-duplicates, line runs, packing, token files and fingerprints against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conceptstrata.llm import imatch, line_runs, packing, passages, simhash, token_files
from conceptstrata.llm.common import Scratch, components, load
from conceptstrata.llm.tokens import Encoder, tokenizer_path

DOCS = "doc_id long, text string"


def texts_of(spark, sf_small):
    return {r.doc_id: r.text for r in load(spark, sf_small, "documents").select("doc_id", "text").collect()}


def roots_of(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 90)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    edges = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(edges, Scratch(spark)).collect()}
    assert got == roots_of(nodes, links)
    assert components(edges.limit(0), Scratch(spark)).count() == 0


def slow_fingerprint(text, size=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, sf_small):
    texts = list(texts_of(spark, sf_small).items())
    rows = texts + [(9000, None), (9001, ""), (9002, "Ä one"), (9003, "ä one"), (9004, " \x0bA  b\tc D"), (9004, " \x0bA  b\tc D"), (9005, "word " * 60_000)]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", fp int")).collect()
    assert len(got) == len(rows)
    prints = {d: slow_fingerprint(t) for d, t in rows}
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = roots_of(prints, near)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", roots[d]) for d in prints}
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 7])
def test_bit_sliced_distance(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(0xE000000000000001), rng.integers(0, 2**63, 100, dtype=np.uint64)])
    want = np.array([[(int(a) ^ int(b)).bit_count() > radius for b in fps] for a in fps])
    assert (simhash.exceeds(fps, fps, radius) == want).all()


def test_a_group_of_more_than_a_tile(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    fps = [(1 << i) | (1 << j) for i in range(12) for j in range(i)] + [(1 << 60) - 1]
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    roots = roots_of(fps, [(r.a, r.b) for r in found])
    want = roots_of(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3])
    assert len(set(roots.values())) == len(set(want.values())) and all((r.a ^ r.b).bit_count() <= 3 for r in found)


def bare_lines(text):
    return [x.strip(" \t\r") for x in text.split("\n") if x.strip(" \t\r")]


def repeated_places(rows, least):
    """Per document the lines in maximal runs that have `least` characters and stand at an earlier place, too."""
    bare = {k: bare_lines(t) for k, t in rows}
    at, places = {}, [(k, i) for k in sorted(bare) for i in range(len(bare[k]))]
    gone = {k: set() for k in bare}
    for k, i in places:
        for other, j in at.get(bare[k][i], []):
            size = 0
            while i + size < len(bare[k]) and j + size < len(bare[other]) and bare[k][i + size] == bare[other][j + size]:
                size += 1
            if sum(map(len, bare[k][i : i + size])) >= least:
                gone[k] |= set(range(i, i + size))
        at.setdefault(bare[k][i], []).append((k, i))
    return gone


def slow_line_dedup(rows, least):
    """The texts without those lines; blank lines stay, unless nothing else does."""
    gone, out = repeated_places(rows, least), {}
    for k, t in rows:
        kept, at, some = [], -1, False
        for x in t.split("\n"):
            if x.strip(" \t\r"):
                at += 1
                if at in gone[k]:
                    continue
                some = True
            kept.append(x)
        out[k] = t if not gone[k] else "\n".join(kept) if some else ""
    return out


def test_line_dedup_against_brute_force(spark, sf_small):
    rng = random.Random(7)
    pool = [f"line {i} " + "x" * (i % 9) for i in range(12)]
    rows = [(i, "\n".join(rng.choices([*pool, "", f"own {i}"], k=rng.randint(0, 40)))) for i in range(60)]
    rows += [(100, "only once"), (101, ""), (102, "\n\n"), (103, "  a\t\r\n" * 30), (104, rows[3][1]), (105, "y" * 300), (106, "y" * 300 + "\nz")]
    got = line_runs.deduplicate(spark.createDataFrame([(*r, 5) for r in [*rows, (107, None)]], DOCS + ", gone int"), min_chars=40).collect()
    assert {r.doc_id: r.text for r in got} == {**slow_line_dedup(rows, 40), 107: None}
    assert all(r.gone == 5 for r in got)
    texts = list(texts_of(spark, sf_small).items())
    got = line_runs.deduplicate(spark.createDataFrame([*texts, texts[0]], DOCS))
    assert {r.doc_id: r.text for r in got.collect()} == slow_line_dedup(texts, 100) and got.count() == len(texts) + 1
    assert line_runs.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


def whole_runs(rows, least):
    """The lines that stay, without blank ones."""
    gone = repeated_places(rows, least)
    return {k: "\n".join(x for i, x in enumerate(bare_lines(t)) if i not in gone[k]) for k, t in rows}


def test_whole_maximal_runs_go(spark):
    rng = random.Random(11)
    run = ["a" * 120, "b" * 30, "c" * 30]
    rows = [(1, "\n".join([*run, "one"])), (2, "\n".join(["two", *run, "three"])), (3, "\n".join([*run[:2], "four", "c" * 30]))]
    got = line_runs.deduplicate(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.text for r in got} == {1: rows[0][1], 2: "two\nthree", 3: "four\n" + "c" * 30}
    pool = ["p" * 45, "q" * 20, "r" * 9, "s" * 3, "t", "u" * 38, "v" * 12]
    rows = [(i, "\n".join(rng.choices([*pool, f"own {i}"], k=rng.randint(1, 14)))) for i in range(60)]
    got = line_runs.deduplicate(spark.createDataFrame(rows, DOCS), min_chars=40).collect()
    assert {r.doc_id: r.text for r in got} == whole_runs(rows, 40)
    assert whole_runs(rows, 40) == slow_line_dedup(rows, 40)


def test_lines_of_documents_without_id(spark):
    line = "z" * 120
    rows = [(1, line), (None, f"{line}\nown"), (None, f"other\n{line}"), (2, f"{line}\n{line}\nlast"), (None, f"{line}\nown")]
    deep = "\n".join(f"part {i}" for i in range(40))
    rows += [(None, f"first\n{deep}"), (None, f"second\n{deep}"), (5, deep)]
    got = [(r.doc_id, r.text) for r in line_runs.deduplicate(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(t for d, t in got if d is not None) == ["", "", "last"]
    # of the documents without id one keeps each run; equal rows are one document
    free = [t for d, t in got if d is None]
    assert sum(line in t for t in free) in (1, 2) and sum(deep in t for t in free) == 1
    assert {"other", "first", "second", "own"} <= {t.split("\n")[0] for t in free} | {t.split("\n")[-1] for t in free}


def test_suffix_ranks_are_in_order(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choices("abc", k=12))) for i in range(8)]
    lines = line_runs.line_ids(spark.createDataFrame(rows, DOCS), "doc_id", "text")
    state = line_runs.repeated_chains(lines, "doc_id", 4)
    once = line_runs.refine(state, "doc_id", 1).where("r2 is not null").collect()
    text = dict(rows)
    pairs = {}
    for r in once:
        pairs.setdefault(tuple(text[r.doc_id].split("\n")[r.idx : r.idx + 2]), set()).add(r.r2)
    assert all(len(v) == 1 for v in pairs.values()) and len({next(iter(v)) for v in pairs.values()}) == len(pairs)
    by_rank = sorted((next(iter(v)), k) for k, v in pairs.items())
    assert [k[0] for k, _ in itertools.groupby(by_rank, lambda x: x[1][0])] and len({a for a, _ in itertools.groupby(k[0] for _, k in by_rank)}) <= 3


def slow_bound_is_not_beaten(lengths, capacity):
    best = len(lengths)

    def place(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + rest[0] <= capacity:
                place(rest[1:], bins[:i] + [bins[i] + rest[0]] + bins[i + 1 :])
        place(rest[1:], [*bins, rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best


def test_lower_bound_and_best_fit():
    rng = random.Random(4)
    for _ in range(60):
        lengths = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 7))])
        exact = slow_bound_is_not_beaten(lengths.tolist(), 20)
        bins, offsets = packing.best_fit_decreasing(lengths, 20)
        assert packing.lower_bound(lengths, 20) <= exact <= bins.max() + 1
        for b in set(bins.tolist()):
            own = sorted(zip(offsets[bins == b], lengths[bins == b], strict=True))
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 20
    assert packing.lower_bound(np.array([11] * 4 + [9] * 2), 20) == 4 and packing.lower_bound(np.array([], np.int64), 20) == 0


def test_packing(spark, sf_small, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 60)
    texts = list(texts_of(spark, sf_small).items()) + [(9000, None), (9001, ""), (9002, "word " * 30_000), (9002, "word " * 30_000)]
    rows = packing.pack(spark.createDataFrame([(*t, 1) for t in texts], DOCS + ", length int"), tokenizer_path("word_bpe_49k.json")).collect()
    whole = Encoder(tokenizer_path("word_bpe_49k.json"), False)
    ids = {d: whole.whole(t or "") + np.array([1], "<u4").tobytes() for d, t in texts}
    pieces = sum(-(-len(ids[d]) // 4 // 4096) for d, _ in texts)
    assert len(rows) == pieces
    for r in rows:
        part = ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert r.start == 4096 * r.piece and r.length == min(4096, len(ids[r.doc_id]) // 4 - r.start) and r.ids_crc32 == zlib.crc32(part)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096
    least = packing.lower_bound(np.array([r.length for r in rows]), 4096)
    assert least <= len(by) <= 1.06 * least + 4
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_word_by_word_ids_are_those_of_the_whole(spark, sf_small, name, spaced):
    odd = ["", "a", " a  b\n\n c ", "it's don't  x€ y é́ z", "Ü　\tx\r\ny", "x\x1cy <|endoftext|> 漢字 4.5!!??", "ΑΣ ΟΔΟΣ. İI", "\n", "a\n", "\na", "x \x01 y", "a\nb c.\nd, e", "À Ñandú. Öl ſt ĳ ß, à×b", "a\x85b c\u2003d", "one\u00a0two"]
    texts = [*odd, *texts_of(spark, sf_small).values()]
    for room in (600_000, 50):
        encoder = Encoder(tokenizer_path(name), spaced)
        encoder.table.half = room // 2
        assert list(encoder.encode_all(texts)) == [encoder.whole(t) for t in texts]


def test_token_files_round_trip(spark, sf_small, tmp_path):
    texts = list(texts_of(spark, sf_small).items()) + [(9000, None), (9001, ""), (9001, "")]
    path = str(tmp_path / "tokens")
    token_files.write(spark.createDataFrame([(*t, 1) for t in texts], DOCS + ", part int"), path, tokenizer_path("byte_bpe_50k.json"), files=5)
    encoder = Encoder(tokenizer_path("byte_bpe_50k.json"), True)
    start, want = 0, []
    for d, t in sorted(texts, key=lambda x: (x[0], x[1] or "")):
        ids = encoder.whole(t or "") + np.array([2], "<u4").tobytes()
        want.append((d, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    got = token_files.index(spark, path)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
    one = token_files.read(spark, path).where(F.col("doc_id") == texts[5][0])
    assert np.array(one.first().ids, "<u4").tobytes() == encoder.whole(texts[5][1]) + np.array([2], "<u4").tobytes()
    empty = str(tmp_path / "none")
    token_files.write(spark.createDataFrame([], DOCS), empty, tokenizer_path("byte_bpe_50k.json"))
    assert token_files.index(spark, empty).count() == 0


def test_fingerprints(spark, sf_small):
    rows = list(texts_of(spark, sf_small).items()) + [(9000, None), (9001, ""), (9002, "x"), (-5, "one two three four")]
    got = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", bucket int"), buckets=7).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    prints = {}
    for i, (d, t) in enumerate(order):
        t, follower = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + follower[: len(t) // 2]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), d
        prints.setdefault(t, set()).add(got[d].fingerprint)
        a, b = set(got[d].fingerprint.split()), set(got[order[(i + 1) % len(order)][0]].fingerprint.split())
        slots = {x.split(":")[0] for x in a | b}
        assert got[d].near_next == pytest.approx(1.0 if t == follower else len(a & b) / len(slots) if slots else 0.0)
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in got.values() if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > 3 * np.mean([r.near_next for r in long])
    twice = spark.createDataFrame([(1, "same words here"), (1, "same words here"), (None, "no key")], DOCS)
    assert imatch.fingerprints(twice, buckets=3).count() == 3
    assert imatch.fingerprints(spark.createDataFrame([], DOCS), buckets=3).count() == 0


def test_no_document_with_lexicon_terms_has_an_empty_fingerprint(spark):
    rng = random.Random(12)
    shared = [f"shared{i}" for i in range(600)]
    rows = [(i, " ".join(rng.sample([*shared, *[f"own{i}x{j}" for j in range(1 + i)]], 601 + i))) for i in range(60)]
    got = {r.doc_id: r.fingerprint for r in imatch.fingerprints(spark.createDataFrame(rows, DOCS), buckets=3).collect()}
    assert all(got.values()) and len(set(got.values())) == len(rows)
    short = [got[i].split() for i in range(imatch.TERMS)]
    # All lexicon terms of a document of up to TERMS are on its lowest level.
    assert all({x.split(".")[0] for x in p} >= {"0"} and sum(x.startswith("0.") for x in p) >= min(i, 3) for i, p in enumerate(short))
    mixed = spark.createDataFrame([([rng.getrandbits(63) for _ in range(n)],) for n in (1, 5, 24, 25, 300, 5000)], "terms array<long>")
    for r in mixed.select(F.size("terms").alias("n"), imatch.lowest_level(F.col("terms")).alias("low"), F.size(F.filter(imatch.levelled(F.col("terms")), lambda t: t["level"] == imatch.lowest_level(F.col("terms")))).alias("on")).collect():
        assert r.on >= min(r.n, imatch.LEAST_TERMS) and (r.low > 0 or r.on == r.n)


def words_of(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))


def test_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(8)
    passage, near = words_of(rng, 60), words_of(rng, 60).split()
    rows = [(i, words_of(rng, 150)) for i in range(30)]
    for i in (3, 9, 17):
        words = rows[i][1].split()
        rows[i] = (i, " ".join([*words[:70], passage, *words[70:]]))
    for i in (5, 21):
        changed = list(near)
        changed[30] = f"changed{i}" if i == 21 else changed[30]
        rows[i] = (i, rows[i][1] + "\n" + " ".join(changed))
    rows += [(40, None), (41, "")]
    got = passages.removals(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", words int")).collect()
    assert {r.doc_id for r in got} == {3, 5, 9, 17, 21}
    text = dict(rows)
    for r in got:
        if r.kind == "passage" and r.doc_id in (3, 9, 17):
            assert text[r.doc_id][r.begin : r.end].lower() in passage
    assert {(r.doc_id, r.class_key, r.removed) for r in got if r.kind == "paragraph"} == {(5, 5, False), (21, 5, True)}
    assert sum(r.n_words for r in got if r.doc_id == 9) >= 30 and all(r.removed for r in got if r.doc_id == 9)
    assert passages.removals(spark.createDataFrame([], DOCS)).count() == 0


def test_similar_paragraphs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(passages, "TILE", 4)
    rng = random.Random(9)
    base = words_of(rng, 80).split()
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(80)] = words_of(rng, 1)
        rows.append((i, " ".join(words)))
    rows += [(100 + i, words_of(rng, 50)) for i in range(10)]
    got = {r.doc_id: r.class_key for r in passages.removals(spark.createDataFrame(rows, DOCS), min_run=10**6).collect()}
    sets = {d: set(zip(*[t.split()[i:] for i in range(5)])) for d, t in rows}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = roots_of(sets, near)
    members = {r for r in sets if sum(x == roots[r] for x in roots.values()) > 1}
    assert got == {d: roots[d] for d in members}


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_of_odd_texts_equal_those_of_the_whole(name, spaced, monkeypatch):
    """White space of all kinds, marks, case and combining letters; tables that overflow at once."""
    from conceptstrata.llm import tokens

    monkeypatch.setattr(tokens, "TABLE_WORDS", 6)
    monkeypatch.setattr(tokens, "SPACED_WORDS", 6)
    monkeypatch.setattr(tokens, "TAIL_RUNS", 2)
    rng = random.Random(3)
    bits = ["a", "Word", "it's", "x.", "...", "12", "é", "ß.", "naïve!", " ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\x85", "　", "'s", "_", "<|endoftext|>"]
    bits += ["日本", "\x00", "\x1c", "İ", "Σ", "abc.%%%", "***", "A.B", "İ", "fiﬁ", "é", "ŉn"]
    encoder = Encoder(name, spaced)
    for _ in range(4_000):
        text = "".join(rng.choice(bits) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randint(0, 9)))
        assert next(iter(encoder.encode_all([text]))) == encoder.whole(text), repr(text)
