"""Divergence of sources, rendezvous shards, and structure of conversations, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wayline.llm import divergence, rendezvous, structure


@pytest.mark.parametrize("name", ["op11_sketch_divergence", "op12_rendezvous_shards", "op13_structure_repair"])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    found = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(found.columns) == names
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def plain_audit(rows, least, top):
    """rows: (lang, source, text)."""
    rows = [(a or "", b or "", words(t)) for a, b, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(w for r in own for w in set(r[2]))
        kept = sorted(w for w, n in docs.items() if n >= least)
        share = {}
        for source in [*{r[1] for r in own}, None]:
            counts = Counter(w for r in own if source is None or r[1] == source for w in r[2] if w in set(kept))
            total = sum(counts.values())
            share[source] = counts, {w: 1 + 1_000_000_000 * (counts[w] + 5) // (total + 5 * len(kept)) for w in kept}
        sources = [s for s in share if s is not None]
        for s in sources:
            counts, p = share[s]
            q = share[None][1]
            pairs = [(sum(abs(p[w] - share[o][1][w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[w] - q[w], w) for w in kept if counts[w] and p[w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def audit_rows():
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "naïve", "漢字", "ABC", "abc"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "é"]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for _ in range(300)]
    return [*rows, ("en", "a", None), ("xx", "lone", "one two"), ("yy", "p", ""), ("yy", "q", "12 34"), *[rows[0]] * 30]


def test_audit_is_the_plain_one_whatever_the_sketch(spark, empty):
    rows = audit_rows()
    docs = spark.createDataFrame([(i, t, a, b, 1, "x", 2) for i, (a, b, t) in enumerate(rows)], "doc_id int, text string, lang string, source string, term int, n string, p int").repartition(3)
    for least, width in ((4, 1 << 21), (4, 8), (40, 1 << 16)):
        found = divergence.audit(docs, least, 7, width).collect()
        assert sorted(tuple(r) for r in found) == plain_audit(rows, least, 7)
    assert divergence.audit(empty).count() == 0


def test_sketch_never_underestimates_and_rules_out(spark):
    rows = [("en", "a", f"common rare{chr(97 + i % 26)}{chr(97 + i // 26)} {'half' if i % 2 else ''}") for i in range(100)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    for width in (16, 1 << 16):
        limits = divergence.sketch(docs, 40, width=width)
        assert limits.possible(b"en", [b"common", b"half"]).all()
    rare = [f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}".encode() for i in range(100)]
    assert not limits.possible(b"en", rare).any()  # in the wide one
    assert {r.term for r in divergence.counts(docs, limits).collect()} == {"common", "half"}


def test_terms_across_chunks(monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 7)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("abÀ漢 .Z9", weights=[4, 4, 2, 1, 2, 1, 2, 1], k=rng.randint(0, 60)))
        assert [t.decode() for run in divergence.terms_of(text.encode()) for t in run] == words(text)


def test_shards_and_their_growth(spark, docs, rows, empty):
    found = rendezvous.placed(docs, [1.0] * 5).collect()
    assert len(found) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in found if r.doc_id is not None) == sorted((False, d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows if d is not None)
    shards = {}
    for r in found:
        shards.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())
    six = {r.doc_id: r.shard for r in rendezvous.placed(docs, [1.0] * 6).collect()}
    assert all(r.grown_shard == six[r.doc_id] for r in found)
    assert rendezvous.placed(empty, [1.0, 1.0]).count() == 0
    by_text = docs.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text")
    assert rendezvous.placed(by_text, [2.0]).where("shard = 0").count() == len(rows)


def test_equal_rows_share_slots_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rendezvous, "TOGETHER", 16)
    docs = spark.range(3000).select(F.when(F.col("id") < 1000, 7).when(F.col("id") < 1500, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, "same").alias("text"), F.lit(9).alias("shard"), F.lit(1).alias("n"))
    found = rendezvous.placed(docs, [1.0, 3.0, 0.5]).collect()
    shards = {}
    for r in found:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in shards.values()) and len(found) == 3000
    rendezvous.write(docs, f"file://{tmp_path}/out", [1.0, 3.0, 0.5], files=3)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == {s: len(x) for s, x in shards.items()}


def test_weights_and_moves(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before, heavier = [1.0, 1.0, 2.0], [1.0, 1.0, 4.0]
    sizes = {r.shard: r["count"] for r in rendezvous.assigned(docs, before).groupBy("shard").count().collect()}
    assert np.allclose([sizes[k] / 20_000 for k in range(3)], [0.25, 0.25, 0.5], atol=0.02)
    moves = rendezvous.moved(docs, before, heavier).collect()
    assert {r.to_shard for r in moves} == {2} and abs(sum(r.n_rows for r in moves) / 20_000 - 1 / 6) < 0.02
    gone = rendezvous.moved(docs, [1.0] * 4, [1.0] * 3).collect()
    assert {r.from_shard for r in gone} == {3}
    with pytest.raises(ValueError):
        rendezvous.shard_of(["doc_id"], [1.0, 0.0])


def faulty(turns):
    """(fault, initial) of (role, text) turns in order."""
    seen, out = set(), []
    for role, text in turns:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append(("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None, role[:1]))
        seen.add((role, text))
    return out


def cheapest(turns):
    """(cost, audit, lines) by trying every way, with up to two empty turns before each and at the end."""
    best = None
    for letters in product("DKR", repeat=len(turns)):
        for puts in product(range(3), repeat=len(turns) + 1):
            cost, audit, lines, q = 0, "", [], ""
            ok = True
            for (role, text), (fault, initial), letter, put in zip([*turns, (None, None)], [*faulty(turns), (None, None)], [*letters, ""], puts, strict=True):
                for _ in range(put):
                    new = "assistant" if q == "u" else "user"
                    cost, audit, lines, q = cost + 3, audit + "I", [*lines, f"{new}:"], new[0]
                if not letter:
                    continue
                audit += letter
                if letter == "D":
                    cost += 4
                    continue
                if fault in ("blank", "duplicate"):
                    ok = False
                    break
                cost += 3 * (fault == "truncated")
                if letter == "R":
                    role = "assistant" if q == "u" else "user"
                    cost += 3
                    initial = role[0]
                if not (initial == "s" and q == "" or initial == "u" and q in ("", "s", "a") or initial == "a" and q == "u"):
                    ok = False
                    break
                lines, q = [*lines, f"{role}:{text}"], initial
            if ok and q in ("", "a") and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def some_turns(rng, n):
    return [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", " "]), rng.choice(["Yes.", "no", " ", "", "What? ", "Good!", "it is"])) for _ in range(n)]


def expected(turns, numbers, cost, audit, lines):
    marks = faulty(turns)
    known = [n for n in numbers if n is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    count = lambda f: sum(m[0] == f for m in marks)
    illegal = sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False))
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("chunk", [1, 2, 1024])
def test_structure_is_the_cheapest_of_all_ways(spark, chunk):
    rng = random.Random(11)
    talks = {None if k == 0 else f"c{k}": some_turns(rng, rng.randint(1, 4)) for k in range(50)}
    rows, want = [], {}
    for k, turns in talks.items():
        numbers = sorted(rng.sample(range(12), len(turns)))
        numbers[0] = None if rng.random() < 0.2 else numbers[0]
        rows += [(k, n, r or None if r == " " else r, t, 1, "x") for n, (r, t) in zip(numbers, [(None if r == " " else r, None if t == " " else t) for r, t in turns], strict=True)]
        want[k] = expected(turns, numbers, *cheapest(turns))
    rng.shuffle(rows)
    data = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, id int, edits string").repartition(3)
    gone = spark.createDataFrame([("gone", 1)], "conv_id string, n int")
    found = structure.digests(structure.repaired(data, chunk), data.select("conv_id").union(gone.select("conv_id"))).collect()
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found} == want | {"gone": nothing} and len(found) == 51


def plain_repair(turns):
    """By a plain table of (cost, audit, lines) for each state, turn by turn."""
    put = lambda ways: min(ways, key=lambda w: w[:2], default=None)
    due, after = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
    now = {0: (0, "", [])}

    def extended(ways):
        for _ in range(2):
            for q, (cost, audit, lines) in list(ways.items()):
                new = (cost + 3, audit + "I", [*lines, f"{due[q]}:"])
                ways[after[q]] = put([x for x in (ways.get(after[q]), new) if x])
        return ways

    for (role, text), (fault, initial) in zip(turns, faulty(turns), strict=True):
        found = {}
        for q, (cost, audit, lines) in extended(dict(now)).items():
            ways = [(q, cost + 4, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                ways.append((after[q], cost + 3 + extra, audit + "R", [*lines, f"{due[q]}:{text}"]))
                to = 1 if initial == "s" and q == 0 else after[q] if initial == due[q][0] else None
                if to is not None:
                    ways.append((to, cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
            for to, *way in ways:
                found[to] = put([x for x in (found.get(to), tuple(way)) if x])
        now = found
    return put([w for q, w in extended(now).items() if q in (0, 3)])


def test_long_conversations_in_many_chunks(spark, empty):
    rng = random.Random(2)
    talks = {k: [(r, t + str(rng.randint(0, 400)) + rng.choice(["", ".", "?"])) if t.strip() else (r, t) for r, t in some_turns(rng, n)] for k, n in ((1, 700), (2, 3), (3, 90), (4, 1), (None, 40))}
    data = spark.createDataFrame([(k, i, r, t) for k, turns in talks.items() for i, (r, t) in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string").repartition(5)
    want = {k: expected(turns, range(len(turns)), *plain_repair(turns)) for k, turns in talks.items()}
    for chunk in (4, 64):
        turns = structure.repaired(data, chunk).cache()
        assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in structure.digests(turns, data).collect()} == want
        lines = turns.where("conv_id = 3").select("id", F.posexplode("new_turns").alias("k", "t")).orderBy("id", "k").collect()
        assert [f"{r.t.role}:{r.t.text}" for r in lines] == plain_repair(talks[3])[2]
    none = data.where("conv_id = 99")
    assert structure.digests(structure.repaired(none), none).count() == 0


def test_machine_scans_by_table():
    machine = structure.Automaton()
    rng = random.Random(4)
    for _ in range(300):
        structure.repair([rng.randrange(structure.KINDS) for _ in range(rng.randint(0, 40))], machine)
    assert len(machine.vectors) < 60  # a few vectors, whatever is scanned
    assert structure.repair([], machine) == ([], 0)


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, None if t == 3 else "assistant", "Well. It is! Or?" if t is None or t % 4 else None) for c in (None, 1, 2) for t in (None, *range(25))]
    want = []
    for c, t, role, text in rows:
        by = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if by:
            text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
            want += [(c, t, "user" if by == 4 else role, text)] * (2 if by == 3 else 1)
    found = structure.damaged(spark.createDataFrame([(*r, 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, copy int"))
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))
