import numpy as np


def same(got, want, exact: bool = False):
    """Shapes, types, masks and values agree; NaN equals NaN."""
    got, want = np.asanyarray(got), np.asanyarray(want)
    assert got.shape == want.shape, (got.shape, want.shape)
    assert got.dtype == want.dtype, (got.dtype, want.dtype)
    mask = np.ma.getmaskarray(want)
    assert (np.ma.getmaskarray(got) == mask).all()
    a, b = np.ma.getdata(got)[~mask], np.ma.getdata(want)[~mask]
    if want.dtype.kind == "f" and not exact:
        np.testing.assert_allclose(a.astype(float), b.astype(float), rtol={2: 1e-2, 4: 1e-5, 8: 1e-9}[want.dtype.itemsize], atol=1e-12)
    else:
        np.testing.assert_array_equal(a, b)


def dense(shape, seed, mask_rate=0.0, dtype=float):
    rng = np.random.default_rng(seed)
    x = (rng.random(shape) * 10 - 3).astype(dtype) if np.dtype(dtype).kind != "b" else rng.random(shape) < 0.5
    return np.ma.masked_array(x, rng.random(shape) < mask_rate) if mask_rate else x


def sparse(shape, seed, mask_rate=0.0, dtype=float, density=0.3):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(shape) < density, rng.random(shape) * 10 - 4, 0)
    x = x.astype(dtype)
    return np.ma.masked_array(x, (rng.random(shape) < mask_rate) & (x != 0)) if mask_rate else x


def lazy_sparse(spark, x):
    """A sparse array of the cells that are not zero."""
    from tessera import from_coordinates

    there = np.ma.getdata(x) != 0
    places = np.nonzero(there)
    values = np.ma.masked_array(np.ma.getdata(x)[there], np.ma.getmaskarray(x)[there]) if isinstance(x, np.ma.MaskedArray) else x[there]
    return from_coordinates(spark, x.shape, places, values)
