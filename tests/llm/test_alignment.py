"""Alignment against a plain version over whole texts: every pair of tokens is tested for overlap."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sparkprof.llm import alignment
from sparkprof.llm.queries import QUERIES

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_LEVEL}")
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.PIECES}")


def spans(texts, tokenizers):
    """(start, end, id) of the tokens of both sides, by decoding growing prefixes of ids."""
    a, b = tokenizers
    byte = {}
    taken = 0
    for value in range(256):
        if 33 <= value < 127 or 161 <= value < 173 or 174 <= value:
            byte[chr(value)] = value
        else:
            byte[chr(256 + taken)] = value
            taken += 1
    for text in texts:
        if not text:
            yield [], []
            continue
        left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        sides = []
        for side in (left, right):
            at, out = 0, []
            for i, data in side:
                out.append((at, at + len(data), i))
                at += len(data)
            sides.append(out)
        good = all(b"".join(d for _, d in side) == whole for side in (left, right))
        yield sides if good else ([], [])


def expected(rows, tokenizers):
    found, held = [], Counter()
    for (id, text), (left, right) in zip(rows, spans([t for _, t in rows], tokenizers)):
        by_end, links = defaultdict(list), []
        for s, e, i in right:
            by_end[s // 64].append((s, e, i))
            if e // 64 != s // 64:
                by_end[e // 64].append((s, e, i))
        for s, e, i in left:
            near = {x for bucket in range((s - 64) // 64, e // 64 + 2) for x in by_end[bucket]}
            links += [(i, j) for t, u, j in near if t < e and s < u]
        cuts = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(
                ",".join(str(i) for s, e, i in side if start <= s and e <= cut) for side in (left, right)
            ) if len(left) < 3000 else None)
            start = cut
        found.append((id, left, right, groups, links))
        held.update(set(links))
    best = Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    for id, left, right, groups, links in found:
        sha = "" if not left else None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
        yield (id, len(left), len(right), len(groups), len(links), sum(held[x] == best[x[0]] for x in links),
               sum(held[x] for x in links), sha)


def agree(frame, rows, tokenizers):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)
    want = sorted(expected(rows, tokenizers), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7] and w[7] in (None, g[7])


def test_whole_table(spark, small, tokenizers):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    result = QUERIES["op12_alignment"][0](spark, small)
    assert result.columns == COLUMNS
    agree(result, rows, tokenizers)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a b", "tab\tand\nline \r\n end", "<|endoftext|> </s> <s> [INST]",
    "café 你好 \U0001f600 naïve", "▁lower bar", "x▁y", " hard space  em", "<0x0A>", "'s 's don't we'll",
    "12 34 5,6 7.8", "\x1c \x1d", "é combining ́", "word " * 300, "a" * 3000, "你" * 500, "¤ � \x00 z", "a b", "a b",
]


def test_odd_texts(spark, tokenizers):
    """Every row counts, repeated ones too; texts that do not come back have no tokens."""
    rows = list(enumerate(ODD)) + [(None, "a b"), (3, "a b")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, block int, id int")
    result = alignment.link_counts(frame)
    agree(result, rows, tokenizers)
    empty = {r["doc_id"] for r in result.collect() if r["n_a"] == 0}
    assert {0, 1, ODD.index("▁lower bar"), ODD.index("x▁y")} <= empty
    assert alignment.link_counts(frame.limit(0)).collect() == []


def test_small_blocks_give_the_same(spark, small, monkeypatch):
    documents = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    rows = lambda: sorted(map(tuple, alignment.link_counts(documents).collect()))
    before = rows()
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 500)
    assert rows() == before


def test_groups_are_returned(spark, small):
    """The digest is that of the groups in the lists."""
    documents = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    digests = {r["doc_id"]: r["groups_sha256"] for r in alignment.link_counts(documents).collect()}
    for r in alignment.align(documents).collect():
        groups, i, j = [], 0, 0
        for p, q in zip(r["a_cuts"], r["b_cuts"]):
            groups.append(",".join(map(str, r["a"][i:p])) + "|" + ",".join(map(str, r["b"][j:q])))
            i, j = p, q
        assert (i, j) == (len(r["a"]), len(r["b"]))
        assert digests[r["doc_id"]] == hashlib.sha256(";".join(groups).encode()).hexdigest()


def test_groups_by_hand():
    ends = [np.array(e) for e in ([1, 4, 6], [2, 4, 5, 6])]
    cuts = alignment.cut_groups(*(e.tolist() for e in ends))
    assert [c.tolist() for c in cuts] == [[2, 3], [2, 4]]
    assert sorted(zip(*(x.tolist() for x in alignment.links_of(*ends, *cuts)))) == [(0, 0), (1, 0), (1, 1), (2, 2), (2, 3)]


@given(st.sets(st.integers(1, 30)), st.sets(st.integers(1, 30)))
def test_links_are_the_overlaps(a, b):
    sides = [sorted(x | {31}) for x in (a, b)]
    cuts = alignment.cut_groups(*sides)
    found = sorted(zip(*(x.tolist() for x in alignment.links_of(*map(np.array, sides), *cuts))))
    starts = [[0, *x[:-1]] for x in sides]
    assert found == [(i, j) for i in range(len(sides[0])) for j in range(len(sides[1]))
                     if starts[0][i] < sides[1][j] and starts[1][j] < sides[0][i]]


def test_words_change_nothing(spark, small, monkeypatch):
    """A text is aligned alike whole, in words, and beside whatever words; also when words are forgotten."""
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(50).collect()] + ODD
    files = alignment._files(alignment.FOLDER, alignment.BYTE_LEVEL, alignment.PIECES)

    def found(pair, size):
        out = []
        for at in range(0, len(texts), size):
            for rows in pair.rows(texts[at : at + size]):
                links = [] if rows is None else sorted(pair.links(rows).tolist())
                out.append(([x.tolist() for x in pair.lists(rows)], links, rows is not None and pair.groups(rows)))
        return out

    whole = alignment.TokenizerPair(*files)
    whole._separable = False
    expected = found(whole, 1)
    pair = alignment.TokenizerPair(*files)
    assert found(pair, 7) == expected and found(pair, 3) == expected
    monkeypatch.setattr(alignment, "WORDS", 5)
    assert found(pair, 2) == expected
    monkeypatch.setattr(alignment, "STRETCH", 1)
    assert found(alignment.TokenizerPair(*files), 9) == expected
