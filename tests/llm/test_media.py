import hashlib
import random
import zlib

import numpy as np
import pytest

from tideline.llm import media
from tideline.llm.common import stored


def payload_of(found):
    return b"".join(media._BYTE_OF[t].tobytes() for _, _, t in found)


@pytest.mark.parametrize("seed", range(6))
def test_round_trip(seed):
    r = random.Random(seed)
    payloads = [bytes(r.randrange(256) for _ in range(192 * r.randint(1, 12))) for _ in range(9)] + [b"\xff" * 192, b" " * 384, bytes(range(192))]
    values = media.encode(payloads)
    assert [payload_of(f) for f in media.thumbnails(values)] == payloads
    assert all(f[0][0] == 1536 and f[0][1] == 8 * len(p) // 192 for p, f in zip(payloads, media.thumbnails(values)))


def test_high_payload_becomes_several_images():
    assert sum(n for _, n in media._shapes(8190)) == 8190 and len(media._shapes(8190)) == 1
    shapes = media._shapes(42 * 8190 + 8200)
    assert sum(n for _, n in shapes) == 42 * 8190 + 8200 and all(8 * w < 65536 and n * 192 // w <= 8191 for w, n in shapes)
    big = np.random.default_rng(1).integers(0, 256, 192 * 8300, dtype=np.uint8).tobytes()
    found = media.thumbnails(media.encode([big]))[0]
    assert len(found) == 2 and payload_of(found) == big


def bits_image(scan_bits, sof, extra=b"", quant=4):
    """A baseline image of one's own tables: DC categories 0-3 by 2 bits, AC: end, (0,1), (1,2) by 2 bits."""
    bits = scan_bits + "1" * (-len(scan_bits) % 8)
    raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    dc = b"\0" + bytes([0, 3] + [1] + [0] * 13) + bytes([0, 1, 2, 3])
    ac = b"\x10" + bytes([0, 3] + [0] * 14) + bytes([0, 0x01, 0x12])
    n = sof[5]
    sos = bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\0\x3f\0"
    return b"\xff\xd8" + media._segment(0xFE, b"note") + media._segment(0xDB, b"\0" + bytes([quant]) * 64) + media._segment(0xC0, sof) + media._segment(0xC4, dc + ac) + extra + media._segment(0xDA, sos) + raw + b"\xff\xd9"


def test_foreign_images_with_ac_and_colour():
    # grey 16x8: DC +3, coefficients, end; DC -2, end
    grey = bits_image("10" + "11" + "01" + "1" + "10" + "01" + "00" + "10" + "01" + "00", bytes([8, 0, 8, 0, 16, 1, 1, 0x22, 0]))
    (w, h, thumb), = media.thumbnails([grey])[0]
    assert (w, h) == (16, 8) and thumb.tolist() == [[128 + round(3 * 4 / 8), 128 + round(1 * 4 / 8)]]
    # colour 16x16, luminance 2x2: four luminance blocks, then one of each other component, in one unit
    lum = ["01" + "1" + "00", "00" + "00", "01" + "0" + "00", "10" + "10" + "00"]
    colour = bits_image("".join(lum) + "110" + "111" + "00" + "00" + "00", bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]), quant=8)
    (_, _, thumb), = media.thumbnails([colour])[0]
    assert thumb.tolist() == [[129, 129], [128, 130]]


@pytest.mark.parametrize("value", [b"no image", b"\xff\xd8\xff", media.encode([b" " * 192])[0][:-4], media.encode([b"x" * 192])[0].replace(b"\xff\xc0", b"\xff\xc2")])
def test_not_baseline(value):
    with pytest.raises(ValueError):
        media.thumbnails([value])


def test_codes_are_within_the_format():
    for counts in ([5, 0, 0], [1] * 9, [1, 2, 4, 8, 16, 32, 64, 128, 256]):
        lengths = media.code_lengths(np.array(counts))
        assert all((n > 0) == (c > 0) for n, c in zip(lengths, counts)) and max(lengths) <= 16
        assert sum(2.0**-n for n in lengths if n) < 1  # the code of ones stays free


def test_query_columns(spark, docs, odd):
    df = docs(odd)
    got = media.features(stored(media.encode_texts(df), "test-media")).collect()
    want = {}
    for d, t, *_ in odd:
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 or (not raw) * 192)
        want.setdefault(d, set()).add((len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert len(got) == len(odd)
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]]
    by_payload = {}
    for r in got:
        by_payload.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in by_payload.values())
    assert media.features(media.encode_texts(docs([]))).count() == 0
