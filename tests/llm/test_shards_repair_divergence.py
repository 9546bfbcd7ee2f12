"""Histogram sort shards, conversation repair and the divergence audit against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from conceptstrata.llm import conversation_repair, divergence, queries, sharding
from conceptstrata.llm.common import load

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Shards ------------------------------------------------------------------------------------


def slow_shards(rows, shards, tolerance):
    """(doc_id, size, shard, slot) in key order; equal rows are interchangeable."""
    ordered = sorted(rows, key=lambda r: (hashlib.md5((r[1] or "").encode()).hexdigest(), r[0] is not None, r[0] or 0))
    digests = [hashlib.md5((r[1] or "").encode()).hexdigest() for r in ordered]
    sizes = [len((r[1] or "").encode()) + 1 for r in ordered]
    below = [0, *itertools.accumulate(sizes)]
    total = below[-1]
    edges = []
    for i in range(1, shards):
        chosen = None
        for depth in (*range(3, 33, 3), 32):
            starts = [below[j] for j in range(len(rows)) if j == 0 or digests[j][:depth] != digests[j - 1][:depth]]
            near = min([*starts, total], key=lambda b: (abs(shards * b - i * total), b))
            if abs(shards * near - i * total) <= tolerance * total:
                chosen = near
                break
        edges.append(min(below, key=lambda b: (abs(shards * b - i * total), b)) if chosen is None else chosen)
    out, slots = [], Counter()
    for row, size, start in zip(ordered, sizes, below, strict=False):
        shard = sum(e <= start for e in edges)
        out.append((row[0], size, shard, slots[shard]))
        slots[shard] += 1
    return out


def shard_rows(frame):
    return sorted(((r.doc_id, r.size, r.shard, r.slot) for r in frame.collect()), key=lambda r: (r[2], r[3]))


@pytest.mark.parametrize("tolerance", [0.005, 0.2, 0.0])
def test_shards_against_brute_force(spark, tolerance):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 300) + str(rng.randint(0, 400))) for i in range(700)]
    rows += [(1000 + i, "hot copy " * 9) for i in range(400)] + [(2000, "long " * 20_000), (None, None), (3, ""), (4, None)]
    rows += [(None, "no id")] * 3 + [(7, "twice")] * 2
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, slot int").repartition(5)
    found = sharding.shard(frame, 8, tolerance=tolerance)
    assert found.columns == ["doc_id", "text", "size", "shard", "slot"]
    assert shard_rows(found) == slow_shards(rows, 8, tolerance)
    # cells change nothing but the division of the work
    assert shard_rows(sharding.shard(frame, 8, tolerance=tolerance, cell_bytes=3000)) == shard_rows(found)


def test_shards_of_one_text(spark):
    rows = [(5, "same " * 50)] * 300 + [(6, "same " * 50)] * 100
    found = shard_rows(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 16))
    assert Counter(r[2] for r in found) == {s: 25 for s in range(16)}
    assert [r[3] for r in found] == [*range(25)] * 16


def test_shards_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id string, text string, m map<string,int>")
    assert sharding.shard(empty, 4).collect() == []
    one = spark.createDataFrame([("a", "text", {"k": 1})], empty.schema)
    assert [(r.doc_id, r.m, r.slot) for r in sharding.shard(one, 4).collect()] == [("a", {"k": 1}, 0)]


def test_shard_query_keeps_copies_together(spark, sf_small):
    rows = queries.op11_histogram_sort_shards(spark, sf_small).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    ideal = sum(sizes.values()) / 16
    texts = {r.doc_id: r.text for r in load(spark, sf_small, "documents").collect()}
    longest = max(len((t or "").encode()) + 1 for t in texts.values())
    assert len(rows) == len(texts) and all(abs(s - ideal) <= 0.01 * ideal + longest for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_text = defaultdict(set)
    for r in rows:
        by_text[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) - 1 for s in by_text.values()) <= 15  # a splitter cuts one text at most


# Conversations ---------------------------------------------------------------------------------


def slow_repair(rows):
    """Result of one conversation, by the least (cost, initials) of all edits from each place on."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {0: (2, None), 1: (2, None), 3: (2, None), 2: (None, 3)}  # state -> after a user row, after an assistant row

    best = {(len(rows), 0): (0, "", ()), (len(rows), 3): (0, "", ()), (len(rows), 2): (5, "I", ("assistant:",)), (len(rows), 1): (10, "II", ("user:", "assistant:"))}
    for at in reversed(range(len(rows))):
        _, role, text = rows[at]
        must, extra = faults[at] in ("blank", "duplicate"), 5 * (faults[at] == "truncated")
        plain = {}
        for state in range(4):
            user, assistant = after[state]
            options = [(2, "D", None, state)]
            if not must:
                kept = {"u": user, "a": assistant, "s": 1 if state == 0 else None}.get(role[:1])
                if kept:
                    options.append((extra, "K", f"{role}:{text}", kept))
                options.append((1 + extra, "R", ("user" if user else "assistant") + f":{text}", user or assistant))
            plain[state] = min((c + best[at + 1, to][0], e + best[at + 1, to][1], ((line,) if line is not None else ()) + best[at + 1, to][2]) for c, e, line, to in options)
        for _ in range(3):  # insertions before this row
            for state in range(4):
                to = after[state][0] or after[state][1]
                line = "user:" if after[state][0] else "assistant:"
                c, e, lines = plain[to]
                plain[state] = min(plain[state], (c + 5, "I" + e, (line, *lines)))
        for state in range(4):
            best[at, state] = plain[state]
    cost, audit, lines = best[0, 0]
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = Counter(faults)
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)


def found_repairs(spark, rows, **options):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = conversation_repair.report(conversation_repair.repair(frame, **options)).collect()
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def random_rows(rng, conversations, longest):
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?\n", "a. b", "ünï."]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u2"])
            rows.append((conv, None if rng.random() < 0.1 else turn + rng.randint(0, 2), role, rng.choice(texts)))
            if rng.random() < 0.15:
                rows.append(rows[-1])
    return rows


def by_conversation(rows):
    groups = defaultdict(list)
    for conv, *row in rows:
        groups[conv].append(tuple(row))
    return groups


def test_repair_against_brute_force(spark):
    rows = random_rows(random.Random(11), 300, 12)
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (900, None, " ", " "), (901, 5, "system", "Be kind.")]
    rows += [(902, i, "user" if i % 2 else "assistant", f"line {i}.") for i in range(400)] + [(903, 1, "user", "again.")] * 70
    got = found_repairs(spark, rows)
    want = {conv: slow_repair(own) for conv, own in by_conversation(rows).items()}
    assert got == want


def test_long_conversations_in_blocks(spark):
    rng = random.Random(12)
    rows = random_rows(rng, 4, 150) + [(77, None, "user", "x.")] * 40 + [(78, i, "system", "") for i in range(60)]
    rows = [(c, t, r, f"{x}{rng.randint(0, 40)}." if x and rng.random() < 0.7 else x) for c, t, r, x in rows]
    got = found_repairs(spark, rows, long_rows=13)
    assert got == {conv: slow_repair(own) for conv, own in by_conversation(rows).items()}


def test_slabs_do_not_change_the_result(monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice("sua-"), rng.random() < 0.2, rng.random() < 0.3, rng.choice([0, 0, 2])) for _ in range(60)]
    results = set()
    for slab in (1, 3, 16, 100):
        monkeypatch.setattr(conversation_repair, "SLAB", slab)
        price, slabs = conversation_repair.solve(rows, conversation_repair.END_PRICES)
        results.add((price, *conversation_repair.walk(slabs, 0)))
    assert len(results) == 1


def test_repair_of_odd_tables(spark):
    schema = "conv_id string, turn int, role string, text string, edit int, part int"
    empty = spark.createDataFrame([], schema)
    assert conversation_repair.report(conversation_repair.repair(empty)).collect() == []
    rows = spark.createDataFrame([("c", None, None, None, 1, 2), ("c", 3, "user", "z" * 300_000 + ".", 1, 2)], schema)
    (row,) = conversation_repair.report(conversation_repair.repair(rows)).collect()
    assert (row.conv, row.blank, row.gaps, row.audit, row.cost) == ("c", 1, 0, "DD", 4)


def test_query_names_every_conversation(spark, sf_small):
    rows = load(spark, sf_small, "conversations").collect()
    got = {r.conv_id: r for r in queries.op12_conversation_repair(spark, sf_small).collect()}
    assert set(got) == {r.conv_id for r in rows}


# Divergence --------------------------------------------------------------------------------------


def slow_audit(rows, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    uses, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang].add(source)
        uses[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        own = {s: shares(uses[lang, s]) for s in sources}
        whole = shares(sum((uses[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(apart(own[s][t], own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-apart(own[s][t], whole[t]), t.encode(), t) for t in kept if uses[lang, s][t] and own[s][t] > whole[t]]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])}
    return out


def audit_rows(frame):
    got = [tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_audit_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Äh", "ÄH", "naïve", "日本", "X_y", "a1b"]
    rows = []
    for i in range(600):
        source = rng.choice(["hot"] * 4 + [f"s{j}" for j in range(7)])
        body = " ".join(rng.choices(words[: 20 + 10 * len(source)], k=rng.randint(0, 30)))
        rows.append((body.upper() if i % 5 == 0 else body, rng.choice(["en", "fr", None]), source))
    rows += [(None, "en", None), ("", "en", "silent"), ("solo words only", "zz", "a"), ("other", "zz", "b"), ("12 34", "zz", None), ("one", "lone", "x")]
    rows.append(("word " * 100_000, "en", "s1"))
    frame = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS g", "2 AS n", "3 AS p").repartition(6)
    want = slow_audit(rows, 4, 5)
    assert audit_rows(divergence.audit(frame, min_docs=4, top=5)) == want
    monkeypatch.setattr(divergence, "SCALE", divergence.SCALE)
    assert divergence.audit(frame.limit(0)).collect() == []


def test_scatter_in_small_pieces(spark, monkeypatch):
    """Flushed accumulators and counters give the same sums."""
    import pyarrow as pa

    rng = random.Random(4)
    batches = []
    for _ in range(5):
        posts = [[{"g": g, "p": rng.randint(1, 10**9), "b": 1000 + g} for g in rng.sample(range(6), rng.randint(1, 6))] for _ in range(40)]
        kind = pa.list_(pa.struct([("g", pa.int32()), ("p", pa.int64()), ("b", pa.int64())]))
        batches.append(pa.RecordBatch.from_arrays([pa.array([rng.choice("xy") for _ in posts]), pa.array(posts, kind)], ["lang", "postings"]))
    batches.append(batches[0].slice(7, 20))

    def sums():
        out = Counter()
        for b in divergence._scatter(iter(batches)):
            for r in b.to_pylist():
                out[r["lang"], r["g"], r["h"]] += r["v"]
        return out

    want = Counter()
    for b in batches:
        for r in b.to_pylist():
            for one, two in itertools.permutations(r["postings"], 2):
                if one["g"] < two["g"]:
                    f = lambda p, q: (p - q) ** 2 // (p + q)
                    want[r["lang"], one["g"], two["g"]] += f(one["p"], two["p"]) - f(one["p"], two["b"]) - f(one["b"], two["p"]) + f(one["b"], two["b"])
    whole = sums()
    monkeypatch.setattr(divergence, "FLAT_CELLS", 1)
    assert whole == sums() == want
