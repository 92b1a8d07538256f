"""Operators 11 to 13 against the library, a plain tree and exhaustive search."""

import itertools
import random
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import conversations, merkle, queries, sentence_pieces

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.PieceModel(queries.piece_model_path())


# 11

@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(
    st.sampled_from("aeth ▁\n\t-=0é梦日本😀\0�"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_pieces_equal_the_library(model, library, texts):
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_eos=True)
        assert model.decode(ids) == library.decode(ids.tolist())


@settings(max_examples=300, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 260), st.just(28705)), max_size=9))
def test_any_ids_decode_as_in_the_library(model, library, ids):
    assert model.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_long_runs_without_a_cut(model, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeghinorst") for _ in range(40_000)), "a" * 5_001, " " * 5_001, "th" * 9_999]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_eos=True)


def test_merge_rounds_merge_by_rank(model):
    symbols = model.symbol[[ord(c) for c in "thethe"]]
    merged, place = model.merge_rounds(symbols, np.array([0, 0, 0, 1, 1, 1]))
    assert len(set(merged.tolist())) == 1 and place.tolist() == [0, 3]


def test_encode_and_decode_tables(spark, library):
    rows = [(1, "Hello  world", "x"), (None, None, "y"), (2, "", "z"), (2, "", "z"), (3, "\n" * 3 + "é" * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = queries.piece_model_path()
    coded = sentence_pieces.encode(docs, path)
    assert coded.columns == ["doc_id", "ids"]
    want = sorted((str(k), library.encode(t or "", add_eos=True)) for k, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in coded.collect()) == want
    back = sentence_pieces.decode(coded, path).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in back) == sorted((str(k), t or "") for k, t, _ in rows)
    assert sentence_pieces.decode(sentence_pieces.encode(docs.where("false"), path), path).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [])], "k long, ids array<int>")
    assert {r["k"]: r["decoded"] for r in sentence_pieces.decode(odd, path).collect()} == {1: None, 2: ""}


def test_pieces_of_documents(spark, library):
    got = {r["doc_id"]: r for r in queries.op11_sentence_pieces(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(got)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_eos=True)
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == sha256(library.decode(ids).encode()).hexdigest()


# 12

def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha256("".join(below[i:i + 8]).encode()).hexdigest() for i in range(0, len(below), 8)])
    return levels


def plain_proof(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i - i % 8
        out += [h for j, h in enumerate(nodes[first:first + 8], first) if j != i]
        i //= 8
    return out


def plain_leaf(row):
    said = ("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)
    return sha256("".join(said).encode()).hexdigest()


def tree_rows(n):
    rng = random.Random(n)
    langs = [None, "", "de", "en", "é", "en", "en"]
    rows = [(None if i % 50 == 7 else i, rng.choice(langs), f"text {rng.random()}") for i in range(n)]
    return rows + [r for r in rows if r[0] is None and r[1] == "en"][:3]


@pytest.mark.parametrize("n", [0, 1, 9, 300])
def test_manifest_equals_a_plain_tree(spark, n):
    rows = tree_rows(n)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, lang string, text string, g int, leaf string")
    made = merkle.manifest(docs, ["doc_id", "lang", "text"], keep={"text": F.upper("text")})
    got = merkle.folded(merkle.proofs(made)).collect()
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(((row[0] is not None, row[0] or 0), plain_leaf(row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels([leaf for _, leaf, _ in sorted(groups[g], key=lambda x: x[:2])]) for g in order}
    top = plain_levels([trees[g][-1][0] for g in order]) if order else [[]]
    assert [r["root"] for r in made.root.collect()] == top[-1]
    want = []
    for at, g in enumerate(order):
        for i, (_, leaf, row) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            proof = "".join(plain_proof(trees[g], i) + plain_proof(top, at))
            want.append((str(row[0]), leaf, trees[g][-1][0], proof, row[2].upper()))
    assert sorted((str(r["key"]), r["leaf"], r["subroot"], r["proof"], r["keep_text"]) for r in got) == sorted(want)
    assert all(r["folded_root"] == r["root"] == top[-1][0] for r in got)


def test_blocks_share_one_fetch(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.col("id").cast("string").alias("text"))
    made = merkle.manifest(docs, ["doc_id", "text"])
    some = merkle.folded(merkle.proofs(made, made.leaves.where("key % 97 = 5 or key > 4990"))).collect()
    levels = plain_levels([plain_leaf((i, str(i))) for i in range(5000)])
    assert len(some) == len([i for i in range(5000) if i % 97 == 5 or i > 4990])
    for r in some:
        assert r["idx"] == r["key"] and r["proof"] == "".join(plain_proof(levels, r["key"]))
        assert r["folded_root"] == levels[-1][0]
    wrong = merkle.folded(merkle.proofs(made, made.leaves.where("key = 4").withColumn("bad", F.sha2("leaf", 256))), "bad")
    assert wrong.first()["folded_root"] != levels[-1][0]


@settings(max_examples=60, deadline=None)
@given(n=st.integers(1, 600), data=st.data())
def test_missing_is_what_cannot_be_derived(n, data):
    places = sorted(data.draw(st.sets(st.integers(0, n - 1), min_size=1, max_size=30)))
    levels = plain_levels([sha256(bytes([i % 256, i // 256])).hexdigest() for i in range(n)])
    needed, known = set(), set(places)
    for level in range(len(levels) - 1):
        run = {j for i in known for j in range(i - i % 8, min(len(levels[level]), i - i % 8 + 8))}
        needed |= {(level, j) for j in run - known}
        known = {i // 8 for i in known}
    got = merkle.missing(np.array(places), n)
    assert sorted(got) == sorted(needed) and len(set(got)) == len(got)
    built, root = merkle._derived({i: levels[0][i] for i in places}, n, {c: levels[c[0]][c[1]] for c in got})
    assert root == levels[-1][0]
    for i in places:
        proof = merkle._siblings(built, i, n)
        assert proof == "".join(plain_proof(levels, i)) and merkle.fold(levels[0][i], proof, i, n, 0, 1) == root


# 13

def cheapest(kinds):
    """(cost, edits) by trying every string of edits with up to three insertions in a row."""
    best = None
    gaps = list(itertools.product(range(4), repeat=len(kinds) + 1))
    for edits in itertools.product("DKR", repeat=len(kinds)):
        for gap in gaps:
            cost, state, text = 0, 0, ""
            for k in range(len(kinds) + 1):
                for _ in range(gap[k]):
                    cost, state, text = cost + 2, conversations.NEXT[state], text + "I"
                if k == len(kinds):
                    break
                (initial, fault), edit = divmod(kinds[k], 3), edits[k]
                text += edit
                if edit == "D":
                    cost += 3
                    continue
                if fault == 1:
                    break
                new = conversations.NEXT[state] if edit == "R" else initial + 1 if (
                    (initial, state) == (0, 0) or initial in (1, 2) and conversations.NEXT[state] == initial + 1) else None
                if new is None:
                    break
                cost, state = cost + 2 * (edit == "R") + (fault == 2), new
            else:
                continue
            if text.replace("I", "") == "".join(edits) and state in (0, 3) and k == len(kinds):
                best = min(best or (cost, text), (cost, text))
    return best


def stepped(kinds, start=0, end=None):
    search, out, held = conversations.Survivors(start), [], 0
    for i, kind in enumerate(kinds):
        out += search.step(kind)
        held = max(held, i + 1 - sum(len(e) - e.count("I") for e in out))
    return "".join(out + search.finish(end)), held


def test_survivors_find_the_cheapest_edits():
    rng = random.Random(5)
    for n in (1, 2, 3):
        for _ in range(12):
            kinds = [rng.randrange(12) for _ in range(n)]
            assert stepped(kinds)[0] == cheapest(kinds)[1], kinds
    assert stepped([3, 6])[0] == "KK" and stepped([])[0] == ""


def whole_strings(kinds):
    """The same search with every survivor's whole string."""
    best = {0: (0, "")}
    for kind in kinds:
        new = {}
        for a, b, cost, edits in conversations.moves(kind):
            if a in best:
                found = (best[a][0] + cost, best[a][1] + edits)
                new[b] = min(new.get(b, found), found)
        best = new
    return min((c + 2 * conversations.CLOSING[s], e + "I" * conversations.CLOSING[s]) for s, (c, e) in best.items())


@settings(max_examples=200, deadline=None)
@given(kinds=st.lists(st.integers(0, 11), max_size=60), cuts=st.lists(st.integers(0, 60), max_size=4))
def test_stretches_give_what_the_whole_gives(kinds, cuts):
    want = whole_strings(kinds)[1]
    assert stepped(kinds)[0] == want
    cuts = sorted({c for c in cuts if 0 < c < len(kinds)})
    parts = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, len(kinds)], strict=True)] if kinds else []
    ways = conversations.folded([conversations.transfer(bytes(p)) for p in parts])
    got = "".join(stepped(p, begin, end if i + 1 < len(parts) else None)[0]
                  for i, (p, (begin, end)) in enumerate(zip(parts, ways, strict=True)))
    assert got == want


def test_edits_are_written_as_survivors_meet():
    rng = random.Random(1)
    kinds = [rng.choice([3, 6, 3, 6, 4, 8]) for _ in range(20_000)]
    assert stepped(kinds)[1] < 100


def plain_repair(rows):
    """rows (turn, role, text) of one conversation: repaired turns, edits, cost and fault counts."""
    rows = sorted(((t is not None, t or 0), r or " " if r is None else r, x if x is not None else " ") for t, r, x in rows)
    seen, kinds, faults = set(), [], []
    for _, role, text in rows:
        bare = text.strip(conversations.BLANKS)
        fault = ("blank" if not bare else "duplicate" if (role, text) in seen else
                 "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
        faults.append(fault)
        kinds.append(("sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3) * 3
                     + {"blank": 1, "duplicate": 1, "truncated": 2, "": 0}[fault])
    cost, audit = whole_strings(kinds)
    out, state, i = [], 0, 0
    for e in audit:
        role, text = ("", "") if e == "I" else rows[i][1:]
        i += e != "I"
        if e == "D":
            continue
        state = conversations.NEXT[state] if e != "K" else "sua".find(role[0]) + 1
        out.append(f"{role if e == 'K' else conversations.ROLES[state]}:{text}")
    pairs = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return ["\n".join(out), audit, cost, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), pairs]


def test_repair_equals_a_plain_pass(spark):
    rng = random.Random(9)
    said = ["Hello.", "hello", "", " \t\n", "What?", None, "Yes! ", "Yes! ", "so\n"]
    rows = [(c if c else None, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", None, "tool", ""]),
             rng.choice(said) if rng.random() < .5 else f"{rng.random()}.") for c in range(12) for _ in range(rng.randrange(1, 9))]
    # one conversation with most rows, which goes on over several partitions
    rows += [(5, i, rng.choice(["user", "assistant"]), rng.choice(said) or f"turn {i}.") for i in range(400)]
    rows += rows[:4]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, g string, at int")
    made = conversations.repair(turns)
    read = {r["conv_id"]: r for r in conversations.read_out(made.rows).collect()}
    faults = {r["conv_id"]: r for r in made.faults.collect()}
    assert len(faults) == len(read) == len({r[0] for r in rows}) and made.faults.count() == len(faults)
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == conv]
        text, audit, cost, *counts = plain_repair(mine)
        turned = {r[0] for r in mine} - {None}
        assert read[conv]["audit"] == audit and read[conv]["cost"] == cost
        assert read[conv]["repaired_sha256"] == sha256(text.encode()).hexdigest()
        assert [faults[conv][c] for c in ("blank", "duplicate", "truncated", "illegal")] == counts
        assert faults[conv]["gaps"] == (max(turned) - min(turned) + 1 - len(turned) if turned else 0)
    kept = made.rows.where("edit <> 'D'").orderBy("at").collect()
    assert all(r["role"] and r["text"] is not None for r in kept if r["edit"] != "K")


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    made = conversations.repair(none)
    assert made.faults.count() == made.rows.count() == conversations.read_out(made.rows).count() == 0


# 3, whose method has changed

def test_lines_of_documents_against_all_pairs(spark):
    from collections import Counter, defaultdict

    import brute

    from plumbline.llm import line_dedup
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    places = defaultdict(list)
    for doc_id, text in docs.collect():
        for at, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" ").lower()
            if line.strip(line_dedup.BLANKS):
                places[line].append((doc_id, at))
    lines = sorted(places)
    sets = [{line[i:i + 5] for i in range(len(line) - 4)} for line in lines]
    links, postings = [], defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for sh in s for j in postings[sh])
        links += [(i, j) for j, c in common.items() if c >= 0.75 * (len(s) + len(sets[j]) - c)]
        for sh in s:
            postings[sh].append(i)
    groups = defaultdict(list)
    for line, root in zip(lines, brute.roots(len(lines), links), strict=True):
        groups[root] += places[line]
    gone = Counter(doc for spots in groups.values() for doc, _ in sorted(spots)[1:])
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.without_duplicate_lines(docs).collect()}
    assert sum(gone.values()) > 100 and got == {d: gone.get(d, 0) for d in got}
