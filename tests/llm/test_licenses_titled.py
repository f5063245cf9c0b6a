from crosstally.llm import licenses


def test_usual_licence_files(spark):
    """Whole files with a title and copyright lines by word or sign are found."""
    whole = {n: t for n, t in licenses.KNOWN if "\n" in t}
    texts = [(n, f"{title}\n\n{line}\n\n{whole[n]}\n") for n, titles in licenses.TITLES.items() for title in titles for line in ("Copyright (c) 2024 Jane Doe", "© 2024 Jane Doe", "  © 2024 Jane Doe\nAll rights reserved.")]
    texts += [(n, f"© 2024 Jane Doe\n{t}") for n, t in whole.items()] + [(None, f"Some Other License\n\n{whole['MIT']}")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(df).collect()} == {i: n for i, (n, _) in enumerate(texts)}
