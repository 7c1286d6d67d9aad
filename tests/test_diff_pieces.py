"""What a task holds doesn't grow with its table."""

import pandas as pd
from strandwise.operators import revisions

def test_diffs_are_given_out_in_pieces():
    class Pairs:
        def select(self, *_):
            return self

        def mapInPandas(self, diff, _):
            text = "".join(f"line {k}\n" for k in range(10_000))
            return list(diff([pd.DataFrame({"path": [f"p{k}" for k in range(30)], "old": text, "new": text + "end\n"})]))

    given = revisions.text_diffs(Pairs())
    assert sum(map(len, given)) == 30 and max(map(len, given)) < 12
