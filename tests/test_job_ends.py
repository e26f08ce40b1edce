"""First and last event of a job's slice."""

import pandas as pd
import pytest

from docmatch.streaming.jobs import ends


def test_ends_of_a_slice():
    day = [pd.Timestamp(f"2024-01-0{d}") for d in (3, 5, 1, 5)]
    assert ends(pd.Series(day, index=[7, 8, 9, 10])) == (1, day[2])
    assert ends(pd.Series(day[:1], index=[4])) == (0, day[0])
    assert ends(pd.Series([pd.NaT, *day])) == (2, day[2])
    with pytest.raises((KeyError, ValueError)):
        ends(pd.Series([pd.NaT], dtype="datetime64[ns]"))
