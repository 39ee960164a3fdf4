from pyspark.sql import functions as F

from scrollmill.functions import shell

CASES = [
    ("Exit code 1", "grep -r 'a b' src | head -3", True), ("Exit code 1\nout", "cd x && /usr/bin/grep y z 2>/dev/null", True),
    ("Exit code 1", "make all\ngrep x y;", True), ("Exit code 1", "LANG=C git diff --quiet", True), ("Exit code 1", "grep x y > out.txt", False),
    ("Exit code 1", "make && grep x y", False), ("Exit code 1", "grep x y | sed -i s/a/b/ f", False), ("Exit code 1", "ls x", False),
    ("Exit code 1\ngrep: y: No such file or directory", "grep x y", False), ("Exit code 2", "grep x y", False), ("Exit code 1", "grep 'x", False),
    ("Exit code 1", "set -e; grep x y", False), ("Exit code 1", "", False), ("Exit code 1", ";", False), ("Exit code 1", None, False), (None, "grep x y", False),
    ("Exit code 1", "'' | grep x", False),
]


def test_nothing_found(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, t string, c string, want boolean")
    got = df.withColumn("got", shell.nothing_found(F.col("t"), F.col("c"))).collect()
    assert [tuple(r) for r in got if r.got != r.want] == []


ODD = [
    "a 'b c' d", 'x "q\\"r\\\\s\\t" y', "it\\'s", "a'b'\"c\"d", "''", "a '' b", "2>&1|tee f;;x", "a&&b||c|&d", "né × 한 $x {y}", "a # b 'c", "a#b c", "'#' x", "\\# y", "a\nb\n\nc", "", "  ", "'open", 'a "open', "end\\",
    '"a\nb"', "x=1:2 y", "a\x0bb", "(a;b)", "a\\ b", '"\\', "a 'b\\' c", "# all", "a ;# 'b", "\U0001f600 x\U0001f600",
]


def test_words_are_those_of_the_standard_lexer(spark):
    """The standard library's lexer, on odd commands and on all short ones of a small alphabet."""
    import itertools
    import shlex

    def lexed(text):
        try:
            return list(shlex.shlex(text.replace("\n", " ; "), posix=True, punctuation_chars=True))
        except ValueError:
            return None

    every = ODD + ["".join(p) for n in range(1, 6) for p in itertools.product("a'\"\\ #|", repeat=n)]
    long = ["a" * 1999, "'" + "x" * 1990, '"' + "\\x" * 900 + '"', "a'b'" * 400]
    texts = every + long
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, c string").select("i", shell.shell_words(F.col("c")).alias("w")).collect()
    assert [(texts[r.i], r.w, lexed(texts[r.i])) for r in got if r.w != lexed(texts[r.i])][:5] == []
