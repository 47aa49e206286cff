"""Rows that every operator over documents must take."""

EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (5, "one two"), (None, "one two three four"), (6, "Ünï ßẞ 漢字 👩‍👧 <|endoftext|> </s>[INST] \x00\x1c\x85"), (7, "tok " * 30000), (8, "a" * 50000), (9, "it's THE same text it's THE same text " * 20)]
