"""Stand-in user models for the scoring hooks (tests and the query catalogue).

Kept in a module with no Spark imports so executors can unpickle them cheaply.
"""
from __future__ import annotations


def stub_model_factory():
    """Stand-in for a user sequence classifier: (label, confidence) per text.
    Labels follow the reference's label set, including star ratings."""

    def predict(texts):
        out = []
        for t in texts:
            low = t.lower()
            if "the" in low and "ent" not in low:
                out.append(("POSITIVE", 0.9))
            elif "ent" in low and "the" not in low:
                out.append(("negative", 0.8))
            elif "tion" in low:
                out.append(("5 stars", 0.7))
            else:
                out.append(("neutral", 0.6))
        return out

    return predict


def stub_summariser_factory():
    """Stand-in for a user summariser that sometimes gives nothing and sometimes fails."""

    def summarise(texts):
        out = []
        for t in texts:
            kind = len(t) % 5
            if kind == 0:
                raise RuntimeError("the model failed")
            out.append(None if kind == 1 else "" if kind == 2 else f"{len(t)}: {t[:60]}")
        return out

    return summarise
