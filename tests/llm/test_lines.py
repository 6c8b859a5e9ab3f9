"""Words of lines: their order by one number is the order by row, rarity and hash, also where hashes begin alike."""

import numpy as np
import pytest

from siftspark.llm import lines


@pytest.mark.parametrize("same_start", [True, False])
@pytest.mark.parametrize("rows", [50, (1 << lines.ROW_BITS) + 1])
def test_rare_words_first_by_one_number(same_start, rows):
    r = np.random.default_rng(5)
    h = r.integers(0, 1 << 62, 20_000, dtype=np.uint64)
    if same_start:
        h &= np.uint64((1 << 44) - 1)
    h[1::7] = h[::7][: len(h[1::7])]
    row, rarity = r.integers(0, rows, len(h)), r.integers(0, 4, len(h)).astype(np.uint32)
    got = lines._rare_first(h, row, rarity, rows)
    want = np.lexsort((h, rarity, row))
    assert all((x[got] == x[want]).all() for x in (row, rarity, h)) and len(set(got)) == len(h)


def test_words_and_lines_of_a_buffer():
    h, line = lines.words_of(b"A b\r\nb a\x0b\x00 \n\n c\xff\n")
    assert line.tolist() == [0, 0, 1, 1, 1, 3] and h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 4
    assert all(len(x) == 0 for text in (b"", b"\n", b" \n ") for x in lines.words_of(text))
