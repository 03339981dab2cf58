"""Folders and odd texts for the operator tests."""

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

LONG = "lorem ipsum dolor sit amet " * 6000
ODD_TEXTS = [
    (1, "Hello World, hello world"), (2, "hello WORLD, hello world"), (3, None), (4, ""), (5, "   \n\t "),
    (6, "one"), (7, "one two"), (8, LONG), (9, LONG), (10, LONG + "x"), (11, "Ünïcödé straße İstanbul ſecret K"),
    (12, "a <|endoftext|> b <|startoftext|>"), (13, "tabs\tand\x0bvertical\x0cfeeds\r\nlines   nbsp em \x85 nel"),
    (14, "ctl\x1cfile\x1dgroup\x1e\x1f \x00 nul \x7f"), (15, "é combining å \U0001F600 emoji ‍ zwj 日本語 नमस्ते"),
    (16, "it's we've I'll don't 'S 123 4567 ½ ² Ⅷ"), (17, "  leading and trailing  "), (18, "x" * 5000), (19, " " * 3000 + "y"),
    (20, "password = hunter2 password=hunter2hunter2 token: abcdef0123456789"), (1, "Hello World, hello world"),
    (None, "a text without an id"), (21, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa bbbb"), (22, "line\nline\nother\nline\n\n \n"),
]
