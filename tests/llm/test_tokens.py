import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tideline.llm import packing, token_files
from tideline.llm.common import new_folder
from tideline.llm.tokens import Encoder, default_path


def library_ids(text):
    from tokenizers import Tokenizer

    global _tok
    if "_tok" not in globals():
        _tok = Tokenizer.from_file(default_path())
    return _tok.encode(text, add_special_tokens=False).ids


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library():
    r = random.Random(1)
    parts = [" ", " ", " ", "  ", "   ", "\n", "\t", "a", "Bc", "é", "n't", "'s", "12", "$%", "...", " ", "　", "\x1c", "\x85", "<|endoftext|>", "word", ",", "😀", "ß", "́"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(20))) for _ in range(4000)]
    enc = Encoder(default_path(), max_entries=50)
    for a in range(0, len(texts), 500):
        got = enc.encode(texts[a : a + 500])
        assert [np.frombuffer(g, enc.kind).tolist() for g in got] == [library_ids(t) for t in texts[a : a + 500]]


def test_files_give_back_every_document(spark, docs, odd):
    path = new_folder(spark, "test-token-files")
    token_files.write_tokens(docs(odd), path, default_path(), shard_bytes=20_000, file_bytes=5_000)
    got = token_files.read_tokens(spark, path).collect()
    assert len(got) == len(odd)
    want = Counter((d, len(i := [*library_ids(t or ""), 2]), digest(i)) for d, t, *_ in odd)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    done = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == done
        done += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d)


def test_one_frame_is_read_alone_and_checked():
    import xxhash
    import zstandard

    raws = [np.arange(n, dtype="<u2").tobytes() for n in (5, 0, 3000)]
    frames = [(zstandard.compress(r), len(r), xxhash.xxh64_intdigest(r) & 0xFFFFFFFF) for r in raws]
    blob = token_files.write_file([7, None, 9], frames, 2, 0)
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(blob), read_across_frames=True).read() == b"".join(raws)  # plain readers skip our extras

    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            got = super().read(size)
            self.n += len(got)
            return got

    reader = token_files.Reader(source := Counted(blob))
    before = source.n
    assert reader.doc_ids == [7, None, 9] and reader.read(0).tolist() == [0, 1, 2, 3, 4]
    assert source.n - before == len(frames[0][0])
    broken = bytearray(blob)
    broken[reader.starts[1] + len(frames[0][0]) - 1] ^= 1
    with pytest.raises(Exception):
        token_files.Reader(io.BytesIO(bytes(broken))).read(0)


def test_no_documents(spark, docs):
    path = new_folder(spark, "test-token-files")
    token_files.write_tokens(docs([]), path, default_path())
    assert token_files.read_tokens(spark, path).count() == 0
    assert packing.pack(docs([]), default_path()).count() == 0


def slow_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, left in enumerate(bins) if left >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 100])
    lengths = [r.choice([r.randint(1, capacity), capacity // 3 or 1, 1]) for _ in range(r.randint(1, 200))]
    runs, bins = packing.best_fit_decreasing(Counter(lengths), capacity)
    used, spans, seen = {}, {}, Counter()
    for length, rank, n, first, each, offset in runs.tolist():
        assert rank == seen[length]
        seen[length] += n
        for i in range(n):
            b, at = first + i // each, offset + i % each * length
            used[b] = used.get(b, 0) + length
            spans.setdefault(b, []).append((at, at + length))
    assert seen == Counter(lengths) and len(used) == bins
    assert sorted(capacity - u for u in used.values()) == slow_best_fit(lengths, capacity)
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:]))


@pytest.mark.parametrize("lot_rows", [50_000, 3])
def test_pieces(spark, docs, odd, lot_rows):
    got = packing.pack(docs(odd), default_path(), capacity=256, lot_rows=lot_rows).collect()
    want = Counter()
    for d, t, *_ in odd:
        ids = [*library_ids(t or ""), 0]
        first = len(ids) % 256 or min(256, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, digest(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    place = {}
    for r in got:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in place.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 256
    assert len(place) == len(slow_best_fit([r["length"] for r in got], 256))
