"""Token alignment against the libraries and links one by one."""

import collections
import hashlib

import numpy as np
import pytest

from tracewell.llm import alignment, bpe, queries

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def aligned(rows, a_model, b_model):
    """Rows by the libraries' tokens; ids of A are spelled by the rank file of the same vocabulary."""
    spelled = bpe.token_bytes(P.path("byte_bpe_50k.tiktoken"))

    def piece(i):
        p = b_model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()

    held, own = collections.Counter(), []
    for doc, text in rows:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        a_bytes, b_bytes = [spelled[i] for i in a], [piece(i) for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            own.append((doc, None))
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        groups, i, j = [], 0, 0
        for cut in np.intersect1d(a_end, b_end):
            x, y = int(np.searchsorted(a_end, cut)) + 1, int(np.searchsorted(b_end, cut)) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = collections.Counter()
        for x, y in groups:
            for p, m in collections.Counter(x).items():
                for q, n in collections.Counter(y).items():
                    links[p, q] += m * n
        held.update(links.keys())
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        own.append((doc, (len(a), len(b), len(groups), links, hashlib.sha256(listed.encode()).hexdigest())))
    top = collections.defaultdict(int)
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    out = []
    for doc, x in own:
        if x is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            links = x[3]
            out.append((doc, *x[:3], sum(links.values()), sum(m for p, m in links.items() if held[p] == top[p[0]]), sum(m * held[p] for p, m in links.items()), x[4]))
    return out


def hard():
    rng = np.random.default_rng(2)
    out = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\x00", "a\x00b", "▁a", "a▁ b", "<s> x </s><unk>", "<|endoftext|> y", "é日😀", " x", "a\tb\n c\n\n  d", "ﬁ éx", "we'll it's"]
    out += ["x" * 3000, "日本" * 2000, "ab1é" * 1500, " " * 500, "a" + " " * 500 + "b", "same text", "same text"]
    letters = list("aé日 \n\t1'.<>|▁ 😀XYZ") + [" the", "ing "]
    return out + ["".join(rng.choice(letters, int(rng.integers(1, 80)))) for _ in range(150)]


def test_against_libraries(spark, libraries, tmp_path):
    rows = [*enumerate(hard()), (None, "no id"), (24, "same text")]
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, keys string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(aligned(rows, *libraries), key=str)


def test_wide_groups(spark, libraries, monkeypatch):
    """Groups whose ids are counted before they are paired, in small blocks."""
    monkeypatch.setattr(alignment, "WIDE", 2)
    monkeypatch.setattr(alignment, "OPEN", 5)
    rng = np.random.default_rng(3)
    a, b, size = rng.integers(0, 6, 40), rng.integers(0, 6, 40), [(1, 1), (2, 1), (30, 7), (3, 3), (4, 28)]
    na, nb = (np.array(x) for x in zip(*size, strict=True))
    a_at, b_at, doc = np.cumsum(na) - na, np.cumsum(nb) - nb, np.array([0, 0, 0, 1, 1])
    want = collections.Counter((int(d), int(x) << 16 | int(y)) for d, i, m, j, n in zip(doc, a_at, na, b_at, nb, strict=True) for x in a[i : i + m] for y in b[j : j + n])
    who, key, many = alignment.pairs(a, b, a_at, na, b_at, nb, doc)
    assert {(int(d), int(k)): int(m) for d, k, m in zip(who, key, many, strict=True)} == want


def test_bitsets():
    rng = np.random.default_rng(6)
    for n in (1, 63, 64, 65, 500):
        a, b = (np.append(np.sort(rng.choice(np.arange(1, n), min(n - 1, k), replace=False)), n) for k in (n // 3, n // 4))
        cut, a_rank, b_rank = alignment.shared_cuts(a, b, n)
        assert cut.tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        assert a_rank.tolist() == [int((a <= c).sum()) for c in cut] and b_rank.tolist() == [int((b <= c).sum()) for c in cut]


def test_empty(spark):
    args = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model"), P.PATTERN
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), *args).count() == 0
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(1, None)], "doc_id int, text string"), *args).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
