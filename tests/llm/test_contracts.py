"""Each query's operator against a brute-force version, on odd texts and on the smallest tables."""

import base64
import binascii
import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenlake.llm import bpe, chat, licenses, media, neighbours, packing, simhash, substrings, toxicity, warc

SF = "/root/testdata/sf0.001"
LONG = "Lorem ipsum, dolor sit amet. " * 3000
ODD = [
    None, "", " ", "a", "All Rights reserved.", "CC BY cc by-nc all rights reserved general public license", "x y z  \n\n  w", "'s don't WE'LL 123abc ²³ ½", "\x1c\x1d a \x1f b\x85c",
    "ΣΑΣ Σ. İstanbul ﬁ Å é 가", "<|endoftext|> hi<|endoftext|>", "<|startoftext|>a", "emoji 😀👍🏽 and   tabs\t\tend ", "the end\n", LONG, LONG, "the the the the the the", "idiot you are not",
]


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = real + [(10_000 + k, t) for k, t in enumerate(ODD)]
    return spark.createDataFrame([(i, t, "x", "y", 0, 1.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(3).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def empty(docs):
    return docs.limit(0)


def test_packing(spark, docs, texts):
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    got = packing.pack(spark, docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by.keys() == texts.keys()
    for doc, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k, r in enumerate(sorted(by[doc], key=lambda r: r.piece)):
            part = ids[2048 * k : 2048 * (k + 1)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 2048 * k, len(part), zlib.crc32(part.tobytes()))
        assert len(by[doc]) == -(-len(ids) // 2048)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.05 * -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(spark, empty(docs)).count() == 0


def test_packing_plan_is_tight():
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = Counter(int(x) for x in rng.integers(1, 101, rng.integers(1, 4000)))
        intervals, n = packing.plan(counts, 100)
        filled, seen = defaultdict(list), Counter()
        for length, parts in intervals.items():
            assert sorted(p[0] for p in parts) == [p[0] for p in parts]
            for first, number, sequence, offset in parts:
                assert first == seen[length]
                seen[length] += number
                for k in range(number):
                    filled[sequence + k].append((offset, length))
        assert seen == counts and len(filled) == n
        for places in filled.values():
            assert [o for o, _ in sorted(places)] == [0, *np.cumsum([x for _, x in sorted(places)])[:-1]]
            assert sum(x for _, x in places) <= 100
        big = sum(c for x, c in counts.items() if x > 50)
        assert n <= 1.1 * max(big, sum(x * c for x, c in counts.items()) / 100) + 2


def test_toxicity(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = toxicity.learn(big, labels)
    scored = toxicity.score(big, model).join(labels, "doc_id").where(toxicity.held_out(labels.doc_id)).collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in scored) / len(scored)
    caught = [r.score >= 0.5 for r in scored if r.toxic]
    wrong = [r.score >= 0.5 for r in scored if not r.toxic]
    assert right > 0.97 and sum(caught) / len(caught) > 0.85 and sum(wrong) / len(wrong) < 0.01
    odd = toxicity.score(docs, model)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).count() == docs.count()
    named = docs.withColumns({c: F.lit(1) for c in ("matched", "found", "row")})
    kept = toxicity.clean(named, model)
    assert kept.columns == named.columns and kept.count() == odd.where("score < 0.5").count()
    assert toxicity.score(empty(docs), model).count() == 0
    nameless = spark.createDataFrame([(None, "you idiot"), (None, None)], "doc_id long, text string")
    assert [r.h for r in toxicity.score(nameless, model).select(toxicity.held_out(F.col("doc_id")).alias("h")).collect()] == [False, False]
    twice = big.unionByName(big)
    assert toxicity.training_texts(twice, labels).count() == toxicity.training_texts(big, labels).count() <= toxicity.MAX_TRAIN
    none = toxicity.learn(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("score >= 0.5").count() == 0


def types(text, lexicon={"widiot": 4.0}):  # noqa: B006
    """The clause types that a text matches, and their weights. Types: 8 threat, 4 aimed, 2 negated, 1 reported."""
    return {t: x for t, x in enumerate(toxicity.Grammar(lexicon).clauses(text)[: toxicity.TYPES]) if x}


def test_toxicity_clauses():
    assert types("idiot") == types("kill") == types(None) == types("") == types("You. Idiot!") == {}
    assert types("some idiot here") == {0: 4.0} and types("you idiot") == types("idiot you") == types("she is an idiot") == {4: 4.0}
    assert types("you are not an idiot") == {6: 4.0} and types("not. some idiot") == types("not far, some idiot") == {0: 4.0}
    assert types("not one two three four five an idiot") == {0: 4.0} and types("not nice but an idiot") == {0: 4.0}
    assert types("he said that you, well, you idiot") == {5: 4.0} and types('he is "an idiot" and a big idiot') == {5: 4.0, 4: 4.0}
    assert types("he said so. you idiot") == {4: 4.0}
    assert types("I will kill you") == {12: 2.0} and types("they kill time") == {} and types("you will burn") == {12: 2.0}
    assert types("kill and hurt them") == {12: 4.0} and types("I never hurt you") == {14: 2.0} and types("hurt you, kill time") == {12: 2.0}
    assert types("you idiot. I kill you, you idiot") == {4: 8.0, 12: 2.0}
    for threat in ("I am going to kill you", "ich werde dich töten", "je vais te tuer", "te voy a matar", "ich werde ihn schlagen"):
        assert types(threat) == {12: 2.0}, threat
    for harmless in ("ich werde töten", "je vais tuer le temps", "voy a matar el tiempo", "dich töten", "I will, you kill"):
        assert types(harmless) == {}, harmless


def test_toxicity_paths():
    """The composed machine against an enumeration of all paths of the parts: one is accepted, and it has written the sums."""
    rng = np.random.default_rng(4)
    choice = [c for c in toxicity.CLASSES if c != toxicity.STOP]

    def ends(states, at, classes, weights, sums):
        if at == len(classes):
            return [sums] if all(p.final(q) for p, q in zip(toxicity.PARTS, states)) else []
        c, out = classes[at], []
        if c == toxicity.PAUSE:
            if not all(p.final(q) for p, q in zip(toxicity.PARTS, states)):
                return []
            return ends([p.after_pause(q) for p, q in zip(toxicity.PARTS, states)], at + 1, classes, weights, sums)
        for arcs in itertools.product(*(p.arcs(q, c) for p, q in zip(toxicity.PARTS, states))):
            then, aimed, scope, told = [x for x, _ in arcs], arcs[2][0] != "0", arcs[3][0] > 0, arcs[4][0] > 0
            new = list(sums)
            for _, kind in arcs:
                if kind:
                    new[8 * (kind == toxicity.THREAT) + 4 * aimed + 2 * scope + told] += weights[at]
            out += ends(then, at + 1, classes, weights, new)
        return out

    for _ in range(400):
        n = int(rng.integers(0, 9))
        classes = [choice[k] for k in rng.integers(0, len(choice), n)]
        weights = [float(w) if c in (toxicity.INSULT, toxicity.THREAT) else 0.0 for c, w in zip(classes, rng.integers(1, 9, n))]
        paths = ends([p.start for p in toxicity.PARTS], 0, classes, weights, [0.0] * 16)
        lone = toxicity.accepted(classes, weights)
        assert paths in ([lone], []) and (paths or not any(lone)), classes


def test_licenses(spark, docs, texts):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    upper = {c: c + 32 for c in range(65, 91)}
    got = {r.doc_id: r for r in licenses.scan(spark, docs).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        words = pattern.findall(text.translate(upper))
        found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = got[doc]
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(r.labels.split(",")) >= set(r.base_labels.split(",")) - {""} and 0 <= r.score <= 1
    assert licenses.scan(spark, empty(docs)).count() == 0


def brute_notices(words: list[str]) -> set[str]:
    """Labels of the notices in a list of words: every set of equal word pairs within DRIFT diagonals, and every chain of them."""
    out = set()
    for phrase, label in licenses.NOTICES.items():
        t = phrase.split()
        pairs = [(i, k) for i in range(len(words) - 1) for k in range(len(t) - 1) if words[i : i + 2] == t[k : k + 2]]
        for low in {i - k for i, k in pairs}:
            near = [(i, k) for i, k in pairs if low <= i - k <= low + licenses.DRIFT]
            longest: dict[int, set] = {}
            best = 0
            for i, k in sorted(near):
                covered = max(([k, k + 1], *([*c, k, k + 1] for p, c in longest.items() if near[p][0] < i and near[p][1] < k)), key=lambda c: len(set(c)))
                longest[near.index((i, k))] = covered
                best = max(best, len(set(covered)))
            if best >= len(t) - len(t) // licenses.MISSING:
                out.add(label)
    return out


def test_license_notices(spark):
    rng = np.random.default_rng(31)
    texts = ["of the " * 60, "license cc by\n" * 30, "licensed under CC BY 4.0", "Licensed under CC-BY-NC.", "under the under the terms of the gnu of the gnu terms of the", " ".join(licenses.NOTICES), "free of charge to any person obtaining a copy"]
    for phrase in licenses.NOTICES:
        for edits in (0, 1, 2, 3):
            words = ["word"] * int(rng.integers(0, 9)) + phrase.split() + ["rest"] * 3
            for _ in range(edits):
                at, kind = int(rng.integers(0, len(words))), int(rng.integers(0, 3))
                words[at : at + (kind != 1)] = [] if kind == 0 else ["other"]
            texts += [" ".join(words), " ".join(words * 2)]
    texts += ["a b", "a b"]
    rows = [(k if k % 7 else None, t, 1, "x", "y") for k, t in enumerate(texts)]
    got = licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string, row int, template string, label string")).collect()
    want = Counter()
    for doc, text, *_ in rows:
        words = [w.decode() for w in licenses.words_of(text)]
        base = {label for phrase, label in licenses.BASE.items() if any(words[i : i + len(phrase.split())] == phrase.split() for i in range(len(words)))}
        want[doc, ",".join(sorted(base | brute_notices(words)))] += 1
    assert Counter((r.doc_id, r.labels) for r in got) == want
    assert all((r.score > 0) == (r.labels != "") for r in got) and sum(r.labels != "" for r in got) > 30


def test_chat(spark):
    rows = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "v", "b"), (3, 0, "u", "a"), (3, 1, "v", "b"), (4, 0, None, None), (4, 1, "u", ""), (5, 0, "ua", ""), (6, 0, "u", "a"), (6, 1, "v", "c")]
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.collapse(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == {2: (2, 2), 4: (2, 1), 5: (1, 1), 6: (2, 1)}


def brute_talks(rows):
    """Rendered conversations that are no strict prefix of another, with the smallest id and the number of equal ones."""
    mark = lambda t: re.sub(r"<\|(\\*)im_", lambda m: "<|\\" + m[1] + "im_", t or "")
    talks = defaultdict(list)
    for k, (conv, turn, role, text) in enumerate(rows):
        talks[(conv, None) if conv is not None else (None, k)].append((turn, mark(role).replace("\n", " "), mark(text)))
    parts = {key: tuple((r, t) for _, r, t in sorted(turns)) for key, turns in talks.items()}
    whole = defaultdict(list)
    for (conv, _), turns in parts.items():
        whole[turns].append(conv)
    kept = {t: c for t, c in whole.items() if not any(len(o) > len(t) and o[: len(t)] == t for o in whole)}
    return Counter((min((x for x in c if x is not None), default=None), len(t), len(c), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)) for t, c in kept.items())


def test_chat_against_brute_force(spark):
    rng = np.random.default_rng(41)
    texts = ["a", "b", "", None, "<|im_end|>\n<|im_start|>u\na", "<|\\im_end|>", "c" * 50_000, "x\ny"]
    rows = [(int(c), k, ["u", "v", None, "u\nv"][rng.integers(0, 4) if rng.random() < 0.2 else 0], texts[rng.integers(0, len(texts)) if rng.random() < 0.4 else 0]) for c in range(120) for k in range(int(rng.integers(1, 5)))]
    rows += [(None, 0, "u", "a"), (None, 0, "u", "a"), (None, 1, "w", "alone"), (7, 0, "u", "a"), (7, 0, "u", "a")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "conv_id long, turn int, role string, text string, whole int, rendered string")
    assert Counter(map(tuple, chat.collapse(df).collect())) == brute_talks(rows)
    assert chat.collapse(df.limit(0)).count() == 0


def brute_components(fps: dict[int, int]) -> dict[int, int]:
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_simhash(spark, docs, texts):
    fps = {}
    for doc, text in texts.items():
        words = re.findall("[^\x20\x09-\x0d]+", text.translate({c: c + 32 for c in range(65, 91)}))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps[doc] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    roots = brute_components(fps)
    got = simhash.near_duplicates(spark, docs).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == roots and len(got) == len(texts)
    assert simhash.near_duplicates(spark, empty(docs)).count() == 0


def test_simhash_anchors_cover(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = set(base)
    for x in base:
        for _ in range(15):
            y = x
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= 1 << int(bit)
            fps.add(y)
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def archive(spark, folder, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string, record_type int").write.parquet(str(folder / "pages.parquet"))
    return warc.op6_warc(spark, str(folder)).collect()


def test_warc(spark, tmp_path):
    html = ["<p>é</p>", None, "", "a\r\n\r\nWARC/1.1\r\nb", "<p>é</p>", "x" * 300_000, "", "same", "same", "same"]
    got = {r.page_id: r for r in archive(spark, tmp_path, [(i, f"http://e/{i}\n", h, "d", 1) for i, h in enumerate(html)])}
    last = {h or "": i for i, h in enumerate(html)}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        raw = (h or "").encode()
        own = last[h or ""] == i
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if own else ("revisit", last[h or ""]))


def test_warc_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "u", "a")] * 3 + [(1, "v", "a"), (1, None, "b"), (None, "u", "b"), (None, "u", "c"), (None, "u", "c"), (7, "u", None), (7, "u", "")]
    got = Counter((r.page_id, r.uri, r.payload_bytes, r.record_type, r.refers_to) for r in archive(spark, tmp_path, [(*r, None, None) for r in rows]))
    assert got == Counter({
        (1, "u", 1, "revisit", 1): 3, (1, "v", 1, "response", None): 1, (1, "", 1, "response", None): 1, (None, "u", 1, "revisit", 1): 1,
        (None, "u", 1, "response", None): 1, (None, "u", 1, "revisit", None): 1, (7, "u", 0, "response", None): 1, (7, "u", 0, "revisit", 7): 1,
    })


def test_warc_empty_table(spark, tmp_path):
    assert archive(spark, tmp_path, []) == []


def test_warc_members_are_stepped_over():
    import gzip
    import io

    made = [warc.record("response", f"<{k}>", "u", "D", 70_000, None, np.random.default_rng(k).bytes(70_000)) for k in range(3)] + [warc.record("revisit", "<9>", "u", "D", 5, "<0>", None)]
    whole = b"".join(made)
    assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == 4

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    f = Counted(whole)
    assert [h["warc-record-id"] for h, _ in warc.records(f, {"record_type": {"revisit"}}, False)] == ["<9>"] and f.taken < 20_000
    full = [(h["warc-record-id"], d) for h, d in warc.records(io.BytesIO(whole), {"record_type": {"response"}}, True)]
    assert full == [(f"<{k}>", np.random.default_rng(k).bytes(70_000)) for k in range(3)]
    for other in (gzip.decompress(whole), gzip.compress(gzip.decompress(whole))):
        assert [(h["warc-record-id"], d) for h, d in warc.records(io.BytesIO(other), {"record_type": {"response"}}, True)] == full
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(whole[: len(made[0]) - 5]), {}, True))


def test_substrings(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared = word(120)
    fuzzy = list(shared)
    for i in (20, 50, 51, 90):
        fuzzy[i] = "changed"
    del fuzzy[70]
    texts = {1: word(300) + shared + word(80), 2: word(10) + shared + word(200), 3: fuzzy, 4: word(400), 5: None, 6: [], 7: word(5) + shared[:30] + word(50), 8: shared}
    docs = spark.createDataFrame([(k, None if t is None else " ".join(t), 0) for k, t in texts.items()], "doc_id long, text string, n_chars int")
    got = {(r.doc_id, r.of_doc_id): r for r in substrings.passages(spark, docs).collect()}
    assert got.keys() == {(2, 1), (3, 1), (8, 1)}
    assert (got[2, 1].first_word, got[2, 1].n_words, got[2, 1].of_first_word) == (10, 120, 300)
    assert got[3, 1].n_words >= 100 and got[3, 1].similarity >= 0.8
    left = {r.doc_id: (r.text or "").split() for r in substrings.remove(spark, docs).collect()}
    assert left[2] == texts[2][:10] + texts[2][130:] and left[8] == [] and left[1] == texts[1] and len(left) == 8
    assert substrings.passages(spark, docs.limit(0)).count() == 0


def documents_of(spark, texts):
    return spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")


def test_substrings_pieces_of_a_chain(spark):
    rng = np.random.default_rng(14)  # seeds of this draw are near enough to bridge the 30 words
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    head, foot = word(55), word(55)
    texts = {1: word(30) + head + word(30) + foot + word(30), 2: word(7) + head + word(30) + foot + word(9)}
    got = {(r.first_word, r.n_words, r.of_first_word, r.of_n_words, r.similarity) for r in substrings.passages(spark, documents_of(spark, texts)).collect()}
    assert got == {(7, 55, 30, 55, 1.0), (92, 55, 115, 55, 1.0)}


@pytest.mark.parametrize("n_lines, near", [(3, 1024), (90, 1024), (90, 1)])
def test_substrings_of_frequent_lines(spark, monkeypatch, n_lines, near):
    """Documents 900 and 901 share a passage of six lines, each of which n_lines earlier documents have first; also where every run is too frequent for a window."""
    monkeypatch.setattr(substrings, "NEAR", near)
    rng = np.random.default_rng(13)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    lines = [word(24) for _ in range(6)]
    texts = {100 * k + i: word(60) + line + word(60) for k, line in enumerate(lines) for i in range(n_lines)}
    shared = sum(lines, [])
    texts |= {900: word(40) + shared + word(30), 901: word(20) + shared + word(50)}
    got = substrings.passages(spark, documents_of(spark, texts)).collect()
    assert {(r.doc_id, r.of_doc_id, r.of_first_word - r.first_word) for r in got} == {(901, 900, 20)}
    assert {i for r in got for i in range(r.first_word, r.first_word + r.n_words)} == set(range(20, 164))


def test_window_hashes():
    x = np.random.default_rng(3).integers(0, 5, 400).astype(np.uint64)
    got = substrings.window_hashes(x, 3)
    runs = [tuple(x[i : i + 3]) for i in range(398)]
    assert len(got) == 398 and len(set(got.tolist())) == len(set(runs)) == len({(r, g) for r, g in zip(runs, got.tolist())})
    assert len(substrings.window_hashes(x[:2], 3)) == 0


@pytest.mark.parametrize("size", [50, 60])
def test_substrings_of_passages_whose_halves_are_frequent(spark, size):
    """20 passages in two documents each, and parts of 42 words of them in 40 documents before both and 40 between: brute force over windows of 50 words finds 20 pairs, and so does the operator."""
    rng = np.random.default_rng(17)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts = {}
    for k in range(20):
        shared = word(size)
        for i in range(40):
            texts[1000 * k + i] = word(30) + (shared[:42] if i % 2 else shared[-42:]) + word(30)
            texts[1000 * k + 100 + i] = word(30) + (shared[-42:] if i % 2 else shared[:42]) + word(30)
        texts |= {1000 * k + 50: word(20) + shared + word(40), 1000 * k + 200: word(35) + shared + word(25)}
    first, want = {}, set()
    for doc, words in sorted(texts.items()):
        for i in range(len(words) - 49):
            if (of := first.setdefault(tuple(words[i : i + 50]), doc)) != doc:
                want.add((doc, of))
    got = substrings.passages(spark, documents_of(spark, texts)).collect()
    assert len(want) == 20 and {(r.doc_id, r.of_doc_id) for r in got} == want
    assert all((r.first_word, r.n_words) == (35, size) for r in got)


def test_substrings_of_edited_passages_whose_seeds_are_frequent(spark):
    """20 passages of 60 words in two documents each, the middle word changed in the second, so no window of 50 words is equal; all seeds are in 80 other documents, in parts of 42 words."""
    rng = np.random.default_rng(23)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts, want = {}, set()
    for k in range(20):
        shared = word(60)
        for i in range(40):
            texts[1000 * k + i] = word(30) + (shared[:42] if i % 2 else shared[-42:]) + word(30)
            texts[1000 * k + 100 + i] = word(30) + (shared[-42:] if i % 2 else shared[:42]) + word(30)
        texts |= {1000 * k + 50: word(20) + shared + word(40), 1000 * k + 200: word(35) + shared[:30] + ["changed"] + shared[31:] + word(25)}
        want.add((1000 * k + 200, 1000 * k + 50, 35, 60))
    got = {(r.doc_id, r.of_doc_id, r.first_word, r.n_words) for r in substrings.passages(spark, documents_of(spark, texts)).collect()}
    assert want <= got

def test_substrings_partners_against_all_pairs():
    """Occurrences of one seed in a line of 24 words: each x meets an earlier y that align finds a passage over the seed with, if there is one."""
    rng = np.random.default_rng(29)
    word = lambda n: rng.integers(0, 3000, n).astype(np.uint32) * np.uint32(2654435761)
    line, some = word(24), [word(160) for _ in range(6)]
    made = []
    for i in range(160):
        left, right = (some[i % 6][:80].copy(), some[i % 6][80:].copy()) if i % 4 == 0 else (word(80), word(80))
        for side in (left, right):
            edited = rng.random(80) < 0.12
            side[edited] = word(int(edited.sum()))
        x = np.concatenate([left[80 - int(rng.integers(0, 80)) :], line, right[: int(rng.integers(0, 80))]])
        at = int(np.flatnonzero((np.lib.stride_tricks.sliding_window_view(x, 24) == line).all(axis=1))[0]) + 8
        made.append((i, 0, at, x[max(at - substrings.CONTEXT, 0) : at + substrings.K + substrings.CONTEXT]))

    def over(i, j):
        a, c = (min(made[k][2], substrings.CONTEXT) for k in (i, j))
        return any(lo <= a and hi >= a + substrings.K for lo, hi, *_ in substrings.align(made[i][3], made[j][3], a, a + substrings.K, c, c + substrings.K))

    rows = [(*r[:3], r[3].tobytes()) for r in made]
    got = substrings.partners(rows, rows, 50, 0.8)
    want = {i for i in range(160) if any(over(i, j) for j in range(i))}
    assert all(j < i for i, j in got) and len(want) > 20 and {i for i, j in got if over(i, j)} == want
    assert len(got) < 160 * 159 / 2 / 4


def test_substrings_partners_are_alignments_alone():
    """Occurrences in runs of one word, which share 40 words and more by the bag: only pairs that align finds a passage of are given, so few of them are left to verify."""
    rng = np.random.default_rng(31)
    word = lambda n: rng.zipf(1.3, n).clip(0, 400).astype(np.uint32) * np.uint32(2654435761)
    rows = []
    for i in range(150):
        run = np.full(int(rng.integers(30, 48)), 7, np.uint32)
        x = np.concatenate([word(64), run, word(64)])
        at = 64 + 16 * int(rng.integers(0, 2))
        rows.append((i, 0, at, x[max(at - substrings.CONTEXT, 0) : at + substrings.K + substrings.CONTEXT].tobytes()))
    found = {}
    for i in range(150):
        for j in range(i):
            x, y = (np.frombuffer(rows[k][3], np.uint32) for k in (i, j))
            if spans := substrings.align(x, y, 64, 72, 64, 72):
                found[i, j] = any(lo <= 64 and hi >= 72 for lo, hi, *_ in spans)
    got = substrings.partners(rows, rows, 50, 0.8)
    assert set(got) <= found.keys() and len(found) > 20
    for i in range(150):  # all up to the first over the seed
        mine = [j for a, j in sorted(found) if a == i]
        stop = next((k for k, j in enumerate(mine) if found[i, j]), len(mine))
        assert sorted(j for a, j in got if a == i) == mine[: stop + 1]


def test_substrings_passage_in_parts_of_two_documents(spark):
    """Of the 80 words that 3 repeats from 2, document 1 has the first 40: no part that is matched with one first occurrence has 50."""
    rng = np.random.default_rng(15)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared = word(80)
    texts = {1: word(50) + shared[:40] + word(50), 2: word(30) + shared + word(30), 3: word(10) + shared + word(70)}
    got = [(r.doc_id, r.of_doc_id, r.first_word, r.n_words) for r in substrings.passages(spark, documents_of(spark, texts)).collect()]
    assert got == [(3, 2, 10, 80)]


def test_chains_after_a_block_left_out():
    """A long chain, then a block of 150 words that only the other text has: what follows is one chain of its own."""
    a = list(range(0, 600, 8))
    c = [x if x < 400 else x + 150 for x in a]
    assert sorted(map(len, substrings.chains(a, c))) == [25, 50]


def test_aligned_places():
    rng = np.random.default_rng(12)
    for _ in range(200):
        x, y = rng.integers(0, 4, rng.integers(0, 30)).tolist(), rng.integers(0, 4, rng.integers(0, 30)).tolist()
        got = substrings.aligned_places(x, y)
        assert len(got) == substrings.common_words(x, y) and all(x[i] == y[j] for i, j in got)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))


def test_chains_best_predecessor():
    assert substrings.chains([0, 10, 20, 20], [0, 10, 5, 20]) in ([[0, 1, 3], [2]],)


def test_bpe(spark, docs, texts):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    for r in bpe.decode(bpe.encode(docs)).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids, r.doc_id
        assert bytes(r.text).decode() == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty(docs)).count() == 0


def test_media(spark, docs, texts):
    got = media.digests(media.media(docs)).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == binascii.crc32(padded[-16:])
    assert media.packets(media.media(docs)).count() == sum(max(1, -(-len(t.encode()) // 192)) for t in texts.values())


def test_media_lacing():
    xiph = b"\x81\x00\x05\x02\x02" + b"\xff\x01" + b"\x02" + b"a" * 256 + b"bb" + b"ccc"
    assert media.frames_of(xiph, 0, len(xiph))[2] == [(8, 264), (264, 266), (266, 269)]
    ebml = b"\x81\x00\x05\x06\x02" + b"\x83" + b"\xc0" + b"aaa" + b"bbbb" + b"c"
    assert media.frames_of(ebml, 0, len(ebml))[2] == [(7, 10), (10, 14), (14, 15)]
    frames, cues = media.parse(media.mux(b"x" * 192 * 700))
    assert len(frames) == 700 and len(cues) == 2 and cues[1][0] > 0 and all(fine for *_, fine in cues)
    assert [f[1] for f in frames] == [24 * k for k in range(700)]
    moved = bytearray(media.mux(b"x" * 192 * 700))
    moved[-1] ^= 1
    assert [fine for *_, fine in media.parse(bytes(moved))[1]] == [True, False]


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:1100] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (5200, [])]
    got = neighbours.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    d = x.astype(np.float64)
    found, total = 0, 0
    for q in range(0, 3000, 50):
        s = neighbours.cosines(d, d[q])
        s[q] = -9
        best = np.lexsort((np.arange(3000), -s))[:5]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert len(mine) == 5
        if q == 50:
            assert mine == [100, 101, 102, 103, 104]
        found, total = found + len({*mine} & {*best.tolist()}), total + 5
    assert found / total >= 0.9 and {r.query_id for r in got} == {*range(0, 3000, 50)}
    few = neighbours.search(spark, spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")).collect()
    assert [r.vec_id for r in few if r.query_id == 0] and len(few) == 2


def test_later_chains():
    rng = np.random.default_rng(21)
    for _ in range(300):
        ranges = [(int(a), int(a) + int(n), int(k)) for a, n, k in zip(rng.integers(0, 60, 12), rng.integers(1, 25, 12), rng.integers(1, 4, 12))]
        covered: set[int] = set()
        want = [False] * 12
        for i in sorted(range(12), key=lambda i: (-ranges[i][2], ranges[i][0] - ranges[i][1])):
            words = set(range(*ranges[i][:2]))
            want[i] = words <= covered
            covered |= words
        assert substrings.later(ranges) == want


def test_substrings_recall(spark):
    """Passages of 60 to 200 words in documents of 300 with one word in 20 or one in 10 changed: the words that repeat are found."""
    rng = np.random.default_rng(22)
    word = lambda n: [f"w{int(x)}" for x in rng.zipf(1.3, n) % 20_000]
    texts, planted, doc = {}, {}, 0
    for rate in (0.0, 0.05, 0.1):
        for _ in range(40):
            n = int(rng.integers(60, 200))
            passage = word(n)
            other = [f"x{int(rng.integers(10**6))}" if rng.random() < rate else w for w in passage]
            texts[doc] = word(150) + passage + word(150)
            texts[doc + 1] = word(120) + other + word(180)
            planted[doc + 1] = (rate, doc, range(120, 120 + n))
            doc += 2
    got = defaultdict(set)
    for r in substrings.passages(spark, documents_of(spark, texts)).collect():
        got[r.doc_id, r.of_doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    share = defaultdict(list)
    for d, (rate, of, words) in planted.items():
        share[rate].append(len(got[d, of] & set(words)) / len(words))
    assert np.mean(share[0.0]) > 0.99 and np.mean(share[0.05]) > 0.95 and np.mean(share[0.1]) > 0.9, {k: np.mean(v) for k, v in share.items()}
    extra = sum(len(v - (set(planted[d][2]) if d in planted and planted[d][1] == of else set())) for (d, of), v in got.items())
    assert extra < 0.05 * sum(len(p[2]) for p in planted.values())


def test_substrings_odd_rows(spark):
    rng = np.random.default_rng(23)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    a, b, long = word(80), word(90), word(9000)
    rows = [(1, a + " " + word(9)), (1, b + " tail"), (2, word(5) + " " + a), (2, word(5) + " " + a), (None, a), (3, b), (4, long), (5, long + " end"), (6, "same " * 300), (7, "same " * 200)]
    docs = spark.createDataFrame([(i, t, "c", 1, True) for i, t in rows], "doc_id long, text string, cut_spans string, h int, late boolean")
    got = {(r.doc_id, r.of_doc_id, r.n_words) for r in substrings.passages(spark, docs).collect()}
    assert got == {(2, 1, 80), (3, 1, 90), (5, 4, 9000), (7, 6, 200)}
    left = Counter(tuple(r)[:2] for r in substrings.remove(spark, docs).collect())
    cut = [(i, t) for i, t in rows]
    for i, t in ((2, " ".join(rows[2][1].split()[:5]) + " "), (3, rows[3][1].split()[:5])):
        cut[i] = (2, t if isinstance(t, str) else " ".join(t) + " ")
    cut[5], cut[7], cut[9] = (3, ""), (5, " end"), (7, " ")
    assert left == Counter(cut) and substrings.remove(spark, docs).columns == docs.columns


def test_substrings_windows_on_odd_rows(spark):
    """Frequent seeds in every text: an empty table, columns named like the operator's own, repeated rows, null ids, and one very long text."""
    rng = np.random.default_rng(29)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    line, shared = word(30), word(20)
    rows = [(i, word(25) + line + word(25)) for i in range(40)] + [(50, word(9) + line + shared + word(9)), (60, word(20_000) + line + shared + word(20_000))]
    rows += [(60, rows[-1][1]), (None, line + shared), (61, line)]
    docs = spark.createDataFrame([(i, " ".join(t), 1, True, 0, "c") for i, t in rows], "doc_id long, text string, window long, asked boolean, h int, seeds string")
    got = {(r.doc_id, r.of_doc_id, r.first_word, r.n_words) for r in substrings.passages(spark, docs).collect()}
    assert got == {(60, 50, 20_000, 50)}
    assert substrings.passages(spark, docs.limit(0)).count() == 0 and substrings.remove(spark, docs.limit(0)).columns == docs.columns


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (50, [0.0, 1.0], 1), (50, [1.0, 0.1], 1), (3, [1.0, 0.2], 1), (3, [1.0, 0.3], 2), (4, [2.0, 0.4], 2), (None, [1.0, 0.0], 3), (5, [1.0, 0.0, 0.0], 3)]
    kind = "vec_id long, embedding array<float>, rank int"
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 4)) for r in neighbours.search(spark, spark.createDataFrame(rows, kind)).collect()}
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 4)
    assert got == {
        (0, 1): (50, cos([1, 0], [1, 0.1])), (0, 2): (3, cos([1, 0], [1, 0.2])), (0, 3): (4, cos([1, 0], [2, 0.4])),
        (50, 1): (3, cos([1, 0.1], [1, 0.2])), (50, 2): (4, cos([1, 0.1], [2, 0.4])), (50, 3): (0, cos([1, 0.1], [1, 0])),
    }
    assert neighbours.search(spark, spark.createDataFrame([], kind)).count() == 0


def test_neighbours_of_extreme_magnitudes(spark):
    """Squares of these components overflow or vanish; cosines don't."""
    plain = {0: [2.0, 1.0], 1: [1.0, 2.0], 2: [3.0, 1.0], 3: [-1.0, 1.0]}
    rows = [(100 * i + k, [c * m for c in v], "x") for i, m in enumerate([1.0, 1e200, 1e-170, 2.0**-1060]) for k, v in plain.items()]
    rows += [(1000, [1e308, 1e-308], "x")]
    got = neighbours.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), every=100, k=20).collect()
    by = {(r.query_id, r.vec_id): r.score for r in got}
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for q in (0, 100, 200, 300):
        for i in range(4):
            for k, v in plain.items():
                if 100 * i + k != q:
                    assert by[q, 100 * i + k] == pytest.approx(cos(plain[0], v), abs=1e-12)
        assert by[q, 1000] == pytest.approx(cos(plain[0], [1, 0]), abs=1e-12)


@pytest.mark.parametrize("n", [500, 2500, 9000])
def test_neighbours_recall(spark, n):
    """Vectors without any structure, the hardest case, at several sizes."""
    x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
    got = neighbours.search(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), every=n // 40).collect()
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    found = total = 0
    for q in range(0, n, n // 40):
        s = d @ d[q]
        s[q] = -9
        found += len({r.vec_id for r in got if r.query_id == q} & {*np.argsort(-s)[:5].tolist()})
        total += 5
    assert found / total >= 0.9, found / total


def test_components_broadcast_nothing(spark, monkeypatch):
    plans = []
    plain = simhash.materialize

    def watched(df, tag, *codec):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, tag, *codec)

    monkeypatch.setattr(simhash, "materialize", watched)
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 40), (40, 35)], "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(21)}, **{i: 30 for i in (30, 35, 40)}}
    assert not [p for p in plans if "Broadcast" in p]
