"""Salvage of members that hold several records."""

import gzip

import pytest

from kinfold.llm import warc

RECORDS = [warc.record(i, f"http://x/{i}", (b"body %d " % i) * 300 + bytes((i * 7 + k * k) % 251 for k in range(3000)), None, False) for i in range(6)]


def ids(data):
    return [h["x-page-id"] for kind, *_, h, _ in warc.salvage(data) if kind == "record"]


@pytest.mark.parametrize("where", [3, 700])
def test_bad_record_in_a_member(where):
    broken = bytearray(RECORDS[2])
    broken[where] ^= 0xFF
    data = gzip.compress(b"".join([*RECORDS[:2], bytes(broken), *RECORDS[3:]])) + warc.member(RECORDS[0])
    assert ids(data) == ["0", "1", "3", "4", "5", "0"]
    assert sum(kind == "gap" for kind, *_ in warc.salvage(data)) == 1
    first = bytearray(RECORDS[0])
    first[where] ^= 0xFF
    assert ids(gzip.compress(bytes(first) + b"".join(RECORDS[1:]))) == ["1", "2", "3", "4", "5"]


@pytest.mark.parametrize("level", [0, 6])
def test_cut_and_damaged_members(level):
    whole = gzip.compress(b"".join(RECORDS), level)
    cut = ids(whole[: len(whole) * 2 // 3])
    assert cut == [str(i) for i in range(len(cut))] and len(cut) >= 2
    assert ids(whole[:-8]) == ids(whole[:-8] + bytes(8)) == ["0", "1", "2", "3", "4", "5"]
    after = whole[: len(whole) * 2 // 3] + warc.member(RECORDS[5])
    assert ids(after) == [*cut, "5"]
    assert any(kind == "gap" for kind, *_ in warc.salvage(after))
