import re

from tests.llm.conftest import documents

from vintagebook.llm.fingerprints import fingerprint_report


def units(text):
    return {p for p in re.split(r"\n+|(?<=[.!?])[ \t\n\x0b\f\r]+", text) if p}


def test_every_sentence_end_is_a_paragraph_end(spark):
    """Short sentences, and those ending in several marks, are paragraphs of their own: an edit of one leaves the others."""
    texts = ["THE!! OUANTION!! ANST!! ERS!! MEN!! TIR!! OND!! ", "Yes. No. Why?! Well... So it is. Go on. Stop. ", "A sentence of more than thirty characters. Short. Another one of more than thirty characters! Ha! "]
    found = fingerprint_report(documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    for r in found:
        text, after = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        one, other = units(text), units(edited)
        assert round(r["near_edited"], 9) == round(1 - len(one ^ other) / (len(one) + len(other)), 9) > 0
