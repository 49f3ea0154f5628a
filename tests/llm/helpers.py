"""Small document tables for the tests."""

ODD = [
    (0, "It's <|endoftext|> a x<|startoftext|>y ÀÉ İΣΑΣ ’ é é ﬁ \x1c日本語テスト 🤣 naïve 123 ½²"),
    (1, "than the  " * 40 + "\n\n  The\tStraße größe\r\n"),
    (2, "a" * 3000),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (7, "one two three"),
    (8, "one two three"),
    (8, "one two three"),
]
SCHEMA = "doc_id long, text string"


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
