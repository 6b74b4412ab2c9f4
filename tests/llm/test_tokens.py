"""Token files and packing against plain encodings; exact round trips."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from facsimile.llm import packing, token_files, tokens

ODD = ["a\x1c b", "  x\t\ty\n\n", "\xa0　z  \x85!", "<|endoftext|> a<|endoftext|>", "'s it's 's 'll  ", "x" * 5000, "", " ", "1 2  3\r\n", "!\x1c!\x1f?", "a,b.c! d; Ünï, ß. it's, we'll.", "1,2 x1, ª, ², x², y", "𝔘𝔫 é́,", ". . .", "a.\n\nB"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokens.default_vocabulary())
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def corpus():
    rng = random.Random(4)
    data = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (6, "tie one"), (6, "tie two"), (6, "tie two")]
    data += [(1000 + i, " ".join(rng.choice(["alpha", "Beta,", "γ", "42", "\n"]) for _ in range(rng.randint(1, 900)))) for i in range(60)]
    return data + [(5000, "long words here " * 4000)]


def soup(n, seed=9):
    """Random texts of the characters on which the two vocabularies may cut."""
    rng = random.Random(seed)
    some = [*"aB\xe9\xf1\xd7\xf7\u0142\u03b3\u4e2d\u0e01\u0301\u2581", *"019\xb2\u0663", *"'.,!?$_-\x00\x1c\x7f", *" \t\n\r\x0b\x85\xa0\u2009\u2028\u3000", "'s", "'LL", "  ", " a", "\U0001d518", "<s>", "the", "ing"]
    return ["".join(rng.choices(some, k=rng.randint(0, 40))) for _ in range(n)]


def test_chunks_give_the_ids_of_the_text(plain):
    texts = [*ODD, *soup(3000), None]
    ids, places = tokens.encode_texts(tokens.default_vocabulary(), pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == [plain(t) for t in texts]


def test_chunks_give_the_pieces_of_the_text():
    coder = tokens.PieceEncoder(tokens.default_pieces())
    texts = [t for t in [*ODD, *soup(3000)] if t]
    ids, places = coder.encode(*tokens.text_bytes(pa.array([f" {t}" for t in texts])))
    assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == [coder.model.encode(t) for t in texts]


def test_texts_of_a_sliced_array():
    data, places = tokens.text_bytes(pa.array(["left out", "a", None, "", "\xe9"]).slice(1))
    assert bytes(data) == b"a\xc3\xa9" and places.tolist() == [0, 1, 1, 1, 3]
    assert [x.tolist() for x in tokens.encode_texts(tokens.default_vocabulary(), pa.array([], pa.string()))] == [[], [0]]


def test_kept_chunks_are_bounded(monkeypatch, plain):
    monkeypatch.setattr(tokens, "KEPT_CHUNKS", 5)
    coder = tokens.ByteEncoder(tokens.default_vocabulary())
    texts = [f"w{i} w{i % 7} again" for i in range(300)]
    for k in range(0, 300, 10):
        ids, places = coder.encode(*tokens.text_bytes(pa.array(texts[k : k + 10])))
        assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == [plain(t)[:-1] for t in texts[k : k + 10]]
        assert len(coder.known.keys) <= 5 + 60


def test_files_round_trip(spark, rows, plain, tmp_path):
    data = corpus()
    docs = rows([(i, t, 1) for i, t in data], "doc_id bigint, text string, start int")
    shards = token_files.write(docs, f"file://{tmp_path}/out", length=64)
    got = sorted(token_files.read_documents(spark, shards).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert [-1 if r.id is None else r.id for r in got] == sorted(-1 if i is None else i for i, _ in data)
    want = collections.Counter((i, tuple(plain(t))) for i, t in data)
    assert collections.Counter((r.id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    # random access by sequence equals the stream, and masks cover exactly the real ids
    for s in shards:
        reader, listed = token_files.open_shard(s["folder"], s["tag"])
        ids, mask = map(np.concatenate, zip(*(token_files.sequence(reader, k) for k in range(-(-s["n_ids"] // 64)))))
        assert mask.sum() == s["n_ids"] and mask[: s["n_ids"]].all() and len(ids) % 64 == 0
        stream = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got if s["start"] <= r.start < s["start"] + s["n_ids"]])
        assert (ids[mask] == stream).all()
        assert sum(listed.get_batch(i).num_rows for i in range(listed.num_record_batches)) == s["n_docs"]
    assert token_files.read_documents(spark, token_files.write(docs.limit(0))).count() == 0


def exhaustive_best(counts, capacity):
    first = max(counts)
    sums = {first}
    for n, c in counts.items():
        for _ in range(c - (n == first)):
            sums |= {s + n for s in sums if s + n <= capacity}
    return max(sums)


def test_window_is_the_closest_to_capacity():
    rng = random.Random(9)
    for _ in range(200):
        capacity = rng.randint(5, 60)
        counts = collections.Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 12)))
        used = packing.fill_window(counts, capacity)
        assert all(used[n] <= counts[n] for n in used) and max(counts) in used
        assert sum(n * c for n, c in used.items()) == exhaustive_best(counts, capacity)


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_each_token_once_with_one_open_sequence(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 64, 1024])
    low = 1 if seed % 2 else capacity // 2 + 1
    hist = collections.Counter()
    for _ in range(rng.choice([0, 1, 5, 200])):
        hist[rng.randint(low, capacity - 1)] += rng.choice([1, 2, 300])
    plan, n = packing.plan_windows(dict(hist), capacity)
    sequences, parts = collections.defaultdict(list), collections.defaultdict(list)
    for length, low, high, start, size, first, copies, seq, offset in plan.tolist():
        for r in range(low, high):
            k = first + r - low
            sequences[seq + k // copies].append((offset + k % copies * size, size))
            parts[length, r].append((start, size))

    def end(spans):
        at = 0
        for o, z in sorted(spans):
            assert o == at
            at += z
        return at

    assert set(parts) == {(length, r) for length, c in hist.items() for r in range(c)}
    assert all(end(p) == length for (length, _), p in parts.items())
    assert set(sequences) == set(range(n))
    filled = [end(s) for s in sequences.values()]
    assert max(filled, default=0) <= capacity and sum(f < capacity for f in filled) <= 1


def test_packed_documents(rows, plain):
    data = corpus()
    docs = rows([(i, t, 1) for i, t in data], "doc_id bigint, text string, rank int")
    got = packing.pack(docs, capacity=128).collect()
    by_sequence, by_text = collections.defaultdict(list), collections.Counter()
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length > 0
        by_text[r.id, r.doc_tokens, r.start, r.length, zlib.crc32(r.ids)] += 1
    assert set(by_sequence) == set(range(len(by_sequence)))
    filled = []
    for spans in by_sequence.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        filled.append(at)
    assert max(filled) <= 128 and sum(f < 128 for f in filled) <= 1
    assert sum(filled) == sum(len(plain(t)) for _, t in data)
    for i, t in data:
        ids = np.array(plain(t), "<u4")
        mine = [r for r in got if r.id == i and r.doc_tokens == len(ids) and ids[r.start : r.start + r.length].tobytes() == bytes(r.ids)]
        covered = sorted({(r.start, r.length) for r in mine})
        assert sum(n for _, n in covered) >= len(ids)
    assert packing.pack(docs.limit(0)).count() == 0
