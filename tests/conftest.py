import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tablewright import build_session

    s = build_session("tests", "local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                      spark__sql__shuffle__partitions="4", spark__driver__memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


# Planted defects: one row per kind of trouble, everything read as text.
MESSY = [
    (1, "Ann Lee", "31", "ann@example.org", "1990-02-11", "$41,000", "Sales", "4.1"),
    (2, "bea stone", "forty", "bea@example.org", "03/25/1987", "52000", "support", "3.3"),
    (3, "Carl OLSEN", "-7", "carl@example.org", "1991-14-02", "N/A", "SALES", "N/A"),
    (4, "", "44", "no-at-sign", "1986-06-21", "73000.0", "HR", "4.6"),
    (5, "Dora Kim", "29", "dora@example.org", "02-09-1993", "$81,000.00", "hr", "2.2"),
    (6, "Emil", "888", "emil@", "1979-04-01", "NULL", "Design", "six"),
    (7, "fred HOLT", "27", "fred@example.org", "17/05/1984", "91000", "design", "3.8"),
    (8, "Gil NULL", "unknown", "gil@example.co.uk", "1993-09-26", "not disclosed", "Support", "4.2"),
    (9, "hanna", "36", "hanna@site", "no_date", "$46,500", "Legal", "unknown"),
    (10, "Ivo", "119", "ivo@valid.example", "1989-11-02", "99000", "legal", "5.0"),
    (10, "Ivo", "119", "ivo@valid.example", "1989-11-02", "99000", "legal", "5.0"),
]
MESSY_SCHEMA = ("id bigint, name string, age string, email string, date_of_birth string, salary string, "
                "department string, rating string")


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(MESSY, MESSY_SCHEMA)
