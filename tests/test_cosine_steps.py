"""What a task holds doesn't grow with its table."""

import tracemalloc

import numpy as np
import pandas as pd
from strandwise.operators import vector

def test_cosines_are_made_in_steps():
    draw = np.random.default_rng(1)
    rows = pd.DataFrame({"k": np.arange(4096), "v": list(draw.normal(size=(4096, 8)))})
    tracemalloc.start()
    found = vector._best(10, "vec_id")(rows, rows[:2000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 20_000 and peak < 100_000_000  # at once, 65 MB for each of five matrices
