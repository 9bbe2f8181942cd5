import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import fill_in_middle as fim

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
TEXTS = ["", " ", "\n\t ", "one", " one two ", "a<P>b c", "x <S", "P> y z", "日本 語 テ スト 👩‍👩‍👧 ok", "<M>", "end \x1c\x85 x\r\n\r\n", "w " * 50_000 + "z", "y" * 200_000, "< P > <S <M >"]


def plain(text, key):
    """By joining strings, as it is defined."""
    units = UNIT.findall(text)
    n, h = len(units), [int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab é\n\t<PSM>語 \x0b\x1c", max_size=60), st.integers(0, 400))
def test_equals_the_definition_and_comes_back(text, key):
    *rest, out = fim.transform(text.encode(), str(key))
    assert (*rest, out.decode()) == plain(text, key)
    assert fim.restore(out, rest[1]) == text.encode()


@pytest.mark.parametrize("start,at,end", [(0, 0, 0), (0, 3, 7), (2, 2, 9), (1, 9, 9), (0, 5, 10), (3, 4, 8)])
def test_rotation_and_its_inverse(start, at, end):
    data = bytes(range(10))
    buffer = bytearray(data)
    fim.rotate(buffer, start, at, end)
    assert buffer == data[:start] + data[at:end] + data[start:at] + data[end:]
    fim.rotate(buffer, start, start + end - at, end)
    assert buffer == data


def test_rows(spark):
    rng = random.Random(1)
    rows = [(i, t) for i in range(40) for t in (rng.choice(TEXTS), None)][:60] + [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b c d"), (None, "a b c d")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, form string, n int").repartition(3)
    found = fim.restored(fim.fill_in_middle(docs)).collect()
    want = sorted(((i, *plain(t or "", "" if i is None else i), t or "") for i, t in rows), key=repr)
    assert sorted(map(tuple, found), key=repr) == want and {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.restored(fim.fill_in_middle(docs.limit(0))).collect() == []


def test_bytes_that_are_no_text_stay(spark):
    docs = spark.range(20).selectExpr("id AS doc_id", "cast(unhex('61FF20C328') AS string) AS text")
    back = fim.restored(fim.fill_in_middle(docs)).selectExpr("hex(cast(restored AS binary)) AS h", "form").collect()
    assert {r.h for r in back} == {"61FF20C328"} and len({r.form for r in back}) > 1


def test_an_unknown_form_is_an_error():
    with pytest.raises(ValueError, match="unknown form"):
        fim.restore(b"x", "mps")
