"""Rows shared by the tests: nulls, empty and blank texts, a very long one, repeated rows and ids."""

LONG = " ".join(f"w{i % 9973}x{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, "same text here for all to see"),
       (7, "same text here for all to see"), (7, "same text here for all to see"),
       (8, "another text\nof two lines"), (8, "a second text under one id"), (None, "no id at all"),
       (9, "é. “q”. <|endoftext|> ΣΣ x\x01y\x02z")]
