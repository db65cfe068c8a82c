"""Rows that the tests of this folder share."""

SF = "/root/testdata/sf0.001"

# Nulls, an empty text, white space, no letters, repeats, ties, a very long text, an odd id; extra columns that clash.
LONG = "palabra larga que se repite muchas veces y nunca termina. " * 20_000
TEXTS = [(1, "Hello there, this is a plain English sentence about nothing."), (2, None), (3, ""), (4, "  \n\t "), (5, "12345 !!! ###"),
         (6, "Bonjour à tous, ceci est une phrase tout à fait française."), (7, "Bonjour à tous, ceci est une phrase tout à fait française."),
         (8, LONG), (9, "x"), (10, "日本語 emoji 👍🏽 <|endoftext|> it's I'll  two\x1cspaces\r\n"), (11, "a b c d e f g h i j"),
         (12, "A b c d e f g h i J"), (None, "no id here at all"), (1, "Hello there, this is a plain English sentence about nothing.")]
