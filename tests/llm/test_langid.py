"""Every language is learned."""

from __future__ import annotations

from palimpsest.llm import langid


def test_more_than_64_languages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: seen.extend(langs))
    langid.fit(spark.createDataFrame([(i, f"text {i}", f"l{i % 70}") for i in range(2100)], "doc_id long, text string, lang string"))
    assert len(set(seen)) == 70
