import numpy as np
import pytest

from gaugewell.llm.bpe import vocabulary
from gaugewell.llm.split import KINDS, bisect, split_texts, strengths
from gaugewell.llm.tokens import BYTE_BPE_50K

CELLS = "doc_id bigint, text string, cells array<struct<kind string, execution_count int, start_char int, end_char int>>, cut int"


@pytest.fixture(scope="module")
def v():
    return vocabulary(BYTE_BPE_50K)


def pieces(spark, rows, **kw):
    got = {}
    for r in split_texts(spark.createDataFrame(rows, CELLS), **kw).collect():
        got.setdefault(r.doc_id, {})[r.piece_no] = r
    return {d: [p[k] for k in sorted(p)] for d, p in got.items()}


def test_round_trip_limit_and_overlap(spark, v):
    line = "word another thing\n"
    rows = [
        (1, line * 400, None, 0), (2, "é日本" * 3000, None, 0), (3, "x = 1\n\n" * 900 + "QmFzZTY0" * 2000 + "\nend\n", None, 0),
        (4, "short", None, 0), (5, None, None, 0), (6, "", None, 0), (None, "a" * 9000, None, 0),
    ]
    got = pieces(spark, rows, limit=256, overlap=16)
    assert set(got) == {1, 2, 3, None}
    for d, text in [(r[0], r[1]) for r in rows if r[0] in got]:
        ids, ps = v.encode(text).tolist(), got[d]
        assert [i for p in ps for i in p.ids[p.overlap :]] == ids
        assert [p.piece_no for p in ps] == list(range(ps[0].n_pieces))
        assert "".join(text[p.start_char : p.end_char] for p in ps) == text
        for a, b in zip(ps, ps[1:]):
            assert b.overlap == min(16, b.start_token) and list(b.ids[: b.overlap]) == (ids[: a.end_token])[-b.overlap :]
        assert all(p.n_tokens == len(p.ids) <= 256 for p in ps)
    assert all(p.cut in ("line", "end") for p in got[1])
    # A line is only cut inside where the line itself is too long.
    text = rows[2][1]
    for p in got[3]:
        if p.cut not in ("line", "paragraph", "end"):
            assert text[p.end_char - 1] != "\n" and text.rfind("\n", 0, p.end_char) < p.end_char - 1


def test_exact_limit(spark, v):
    text = "a b" + " c" * 2046
    assert len(v.encode(text)) == 2048
    got = pieces(spark, [(1, text, None, 0), (2, text + " d", None, 0)])
    assert set(got) == {2} and len(got[2]) == 2


def test_cells_win_over_paragraphs(spark):
    a, b = "text line\n\n" * 60, "code\n\n" * 60
    cells = [("markdown", None, 0, len(a)), ("code", 1, len(a), len(a) + len(b)), None]
    got = pieces(spark, [(1, a + b, cells, 0)], limit=260, overlap=10)[1]
    assert [p.end_char for p in got if p.cut == "cell"] == [len(a)]


def test_kinds_of_boundaries(v):
    text = "ab cd\nef\n \ngh é"
    ids = v.encode(text)
    power, chars = strengths(text.encode(), np.cumsum([len(v.bytes[i]) for i in ids]), [])
    at = {int(c): KINDS[p] for c, p in zip(chars, power)}
    assert at[2] == "word" and at[6] == "line" and at[11] == "paragraph"


def test_bisection_terminates_without_boundaries():
    power = np.zeros(5001, np.int8)
    cuts = bisect(power, 7)
    assert max(b - a for a, b in zip(cuts, cuts[1:])) <= 7 and cuts[0] == 0 and cuts[-1] == 5000


def test_small_pieces_are_joined():
    power = np.ones(4001, np.int8)
    power[[1900, 1905, 3000]] = 3
    cuts = bisect(power, 2000)
    assert max(b - a for a, b in zip(cuts, cuts[1:])) <= 2000 and min(b - a for a, b in zip(cuts, cuts[1:])) >= 250


def test_no_rows(spark):
    assert pieces(spark, []) == {}
    assert split_texts(spark.createDataFrame([(1, "a b " * 3000)], "doc_id bigint, text string")).where("cut = 'cell'").count() == 0
    with pytest.raises(ValueError):
        split_texts(spark.createDataFrame([], CELLS), limit=5, overlap=5)
