"""Long texts and chunks of many keys: the same keys and values as those that are held whole."""

from __future__ import annotations

import base64
import random
from collections import Counter

import numpy as np
import pyarrow.fs
import pytest

from tidewell.llm import ctw


@pytest.fixture
def small(monkeypatch):
    for name, n in (("TOGETHER", 50), ("HELD_KEYS", 300), ("FRAME_KEYS", 64), ("ROWS_TOGETHER", 20)):
        monkeypatch.setattr(ctw, name, n)


def _texts(seed: int) -> list[bytes]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdEé", k=rng.choice([1, 2, 5, 90])))
    text = lambda n: "".join(word() + rng.choice([" ", "\n", "  ", "\t\r"]) for _ in range(n)).encode()
    return [text(rng.choice([0, 1, 3, 40])) for _ in range(40)] + [b" " * 200, b"x" * 333, b"\n" * 51 + b"Y " * 40, b""]


def _summed(runs) -> dict[int, int]:
    out: Counter = Counter()
    for k, n in runs:
        for a, b in zip(k.tolist(), n.tolist(), strict=True):
            out[a] += b
    return dict(out)


def _counted(texts: list[bytes]) -> list:
    keys, runs = ctw._Keys(ctw.DEPTH), []
    for t in texts:
        runs += keys.add(t, True)
    return [*runs, keys.result()]


def test_stretches_are_the_text(small):
    for t in _texts(1):
        got = list(ctw.stretches(t))
        assert [w for words, _ in got for w in words] == [*ctw.tokens(t), b""]
        assert b"".join(coded for _, coded in got) == b" ".join(ctw.tokens(t)) + bytes([ctw.EDGE])
        before, keys = bytes([ctw.EDGE]) * ctw.DEPTH, []
        for _, coded in got:
            keys += list(ctw.long_keys(before, coded, ctw.DEPTH))
            before = (before + coded)[-ctw.DEPTH :]
        assert np.concatenate(keys).tolist() == ctw.context_keys([b" ".join(ctw.tokens(t))])[0].tolist()


def test_counts_told_in_runs_are_the_counts(monkeypatch):
    texts = _texts(2)
    whole = _counted(texts)
    assert len(whole) == 1
    for name, n in (("TOGETHER", 50), ("HELD_KEYS", 300), ("ROWS_TOGETHER", 20)):
        monkeypatch.setattr(ctw, name, n)
    runs = _counted(texts)
    assert len(runs) > 2 and max(len(k) for k, _ in runs) < 1_000
    assert _summed(runs) == _summed(whole)


def test_values_by_frame_are_the_values(monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 47, 5_000))
    keys = np.sort(np.concatenate([keys, keys[::7], rng.integers(0, 1 << 40, 2_000)]))
    values = np.sin(keys.astype(float))
    fs = pyarrow.fs.LocalFileSystem()
    monkeypatch.setattr(ctw, "FRAME_KEYS", 64)
    out = ctw._Frames(fs, str(tmp_path / "chunk"))
    for a in range(0, len(keys), 37):
        out.add(keys[a : a + 37], values[a : a + 37])
    out.close()
    asked = rng.permutation(np.concatenate([keys, keys[:50]]))
    for most in (1 << 22, 100):
        monkeypatch.setattr(ctw, "HELD_KEYS", most)
        with fs.open_input_file(str(tmp_path / "chunk")) as file:
            own = ctw._Values(file)
            assert own.held == (most > 100)
            assert own.contexts(asked[asked >= 0]).tolist() == np.sin(asked[asked >= 0].astype(float)).tolist()
            assert own.words(asked[asked < 0]).tolist() == np.sin(asked[asked < 0].astype(float)).tolist()


def test_a_long_text_scores_as_its_words_do(spark):
    """A text of over TOGETHER bytes beside the same words in short ones: tokens and base score add up."""
    rng = random.Random(4)
    line = lambda: base64.b64encode(rng.randbytes(rng.choice([6, 300]))).decode()
    words = [line() for _ in range(22_000)]
    text = "\n".join(words)
    assert len(text) > ctw.TOGETHER
    parts = [words[a : a + 2_000] for a in range(0, len(words), 2_000)]
    rows = [(1, text), *((100 + k, " ".join(p)) for k, p in enumerate(parts))]
    got = {r.doc_id: r for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    short = [got[100 + k] for k in range(len(parts))]
    end = got[1].n_tokens - len(words)
    assert end == 1 and got[1].n_known == sum(r.n_known - 1 for r in short) + 1
    # Each short text has an end token and an end byte of its own.
    n_end = sum(1 for r in short) - 1
    one = (sum(r.base_score for r in short) - got[1].base_score) / n_end
    assert -12 < one < 0 and got[1].score == pytest.approx(sum(r.score for r in short), rel=0.01)
    assert got[1].bits_per_byte == pytest.approx(-got[1].score * np.log2(10) / (len(text) + 1))
