"""Published triangles (fixed values) and small builders."""

from datetime import date

#: Mack (1993), RAA: cumulative losses by accident year.
RAA = {
    1981: (5012, 8269, 10907, 11805, 13539, 16181, 18009, 18608, 18662, 18834),
    1982: (106, 4285, 5396, 10666, 13782, 15599, 15496, 16169, 16704),
    1983: (3410, 8992, 13873, 16141, 18735, 22214, 22863, 23466),
    1984: (5655, 11555, 15766, 21266, 23425, 26083, 27067),
    1985: (1092, 9565, 15836, 22169, 25955, 26180),
    1986: (1513, 6445, 11702, 12935, 15852),
    1987: (557, 4020, 10946, 12314),
    1988: (1351, 6947, 13112),
    1989: (3133, 5395),
    1990: (2063,),
}
RAA_ULTIMATE, RAA_SE = 213122.22826121017, 26880.74032989
SMALL = {2020: (100, 150, 175), 2021: (110, 165), 2022: (120,)}
SCHEMA = "lob string, origin_period date, dev_lag bigint, eval_date date, field string, value double"


def rows(values: dict, lob: str = "auto", field: str = "paid_loss"):
    return [(lob, date(y, 1, 1), 12 * (n + 1), date(y + n, 12, 31), field, float(v)) for y, vs in values.items() for n, v in enumerate(vs)]


def frame(spark, values: dict, lob: str = "auto"):
    return spark.createDataFrame(rows(values, lob), SCHEMA)
