"""Hand-made traffic with results worked out by hand."""

from wiretally.sources.packets import parse_lines

# Six packets; the last two lines have five and eight fields.
SMALL_CAPTURE = """\
10.0.0.1,10.0.0.9,60,ICMP,1,100.10
10.0.0.1,10.0.0.9,60,ICMP,1,100.90
10.0.0.1,10.0.0.9,40,TCP,6,101.00
10.0.0.2,10.0.0.9,60,UDP,17,101.50
10.0.0.9,10.0.0.1,88,ICMP,1,103.00
10.0.0.2,10.0.0.9,70,DNS,17,103.20
10.0.0.1,10.0.0.9,60,ICMP,1
10.0.0.3,10.0.0.9,10.0.0.9,60,ICMP,1,1,103.5
"""


def lines(spark, text):
    return spark.createDataFrame([(line,) for line in text.splitlines()], "value string")


def capture(spark, text, name="attack"):
    return parse_lines(lines(spark, text), name)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())
