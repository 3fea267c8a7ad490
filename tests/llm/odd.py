#: Texts that every operator must take.
ODD = [None, "", " \t\n ", "word", "a b c d", "é" * 3, "x" * 5000, "日本語 テキスト", "one two three four five six seven " * 700, "\x00 nul", "😀 😀", "<|endoftext|> end", "dup text here it is", "dup text here it is"]
ROWS = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id at all"), (3, "word"), (3, "word")]
