"""Named functions for SQL: Arrow-batched measures, and a table function that parses turn lines."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import alignment as A
from lakeloom.functions.text import TURN

SCALARS = {
    "unit_accuracy": (A.accuracy, "double"),
    "partial_ratio": (A.partial_ratio, "double"),
    "token_edits": (lambda a, b: A.edit_distance(A.units(a), A.units(b)), "long"),
    "lcs_ratio": (lambda a, b: A.lcs_ratio(A.units(a), A.units(b)), "double"),
}


class ParseTurns:
    """``parse_turns(text)``: (speaker, start, end, text) of each well-formed ``[S1][0.00-2.50] text`` line."""

    _LINE = re.compile(TURN)

    def eval(self, text: str):
        for line in (text or "").splitlines():
            m = self._LINE.match(line)
            if m:
                yield int(m[1]), float(m[2]), float(m[3]), m[4]


def register(spark: SparkSession) -> None:
    for name, (f, kind) in SCALARS.items():
        spark.udf.register(name, A.batched(f, kind))
    spark.udtf.register("parse_turns", F.udtf(ParseTurns, returnType="speaker int, start double, end double, text string"))
