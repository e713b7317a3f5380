"""The table of chunks that op9 keeps: larger, with the same ids."""

import numpy as np
import public_tokenizers

from sievemill.llm import tokens


def test_wide_table_starts_anew_less_often(monkeypatch):
    monkeypatch.setattr(tokens, "SLOTS", 1 << 12)
    monkeypatch.setattr(tokens, "FULL", 1000)
    path, got = public_tokenizers.path("byte_bpe_50k.json"), []
    for wide in (False, True):
        t, resets, ids = tokens.BatchTokenizer(path, True, wide), [], []
        reset = t.reset
        monkeypatch.setattr(t, "reset", lambda r=resets, f=reset: (r.append(1), f()))
        for k in range(5):
            a = np.frombuffer(" ".join(f"ab{chr(97 + i % 26)}x{i}" for i in range(500 * k, 500 * k + 600)).encode(), np.uint8)
            ids.append(t.run(a, np.array([0, len(a)]))[0].tolist())
            assert ids[-1] == t.tok.encode(a.tobytes().decode(), add_special_tokens=False).ids
        got.append((len(resets), ids))
    assert got[0][0] > 0 and got[1][0] == 0 and got[0][1] == got[1][1]
