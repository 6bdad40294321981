"""Of a PDF no more pages are held than its cut looks at."""

from noteloom.sources.readers import first_pages


def test_first_pages():
    assert first_pages(["a b", None, "c d", "e"], 4) == ["a b", "", "c d"]
    assert first_pages(["a b", "c"], 3) == ["a b", "c"]
    assert first_pages(["a b c", "d"], 2) == ["a b c"]
    assert first_pages([], 2) == []
    assert len(first_pages(["x"] * 100_000, 10)) == 11
