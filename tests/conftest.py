from __future__ import annotations

import pytest

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tessera-tests", "4g")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collected rows as plain tuples, sorted with missing values first."""

    def collected(df, *columns):
        picked = df.select(*[f"`{c}`" for c in columns]) if columns else df
        return sorted(
            (tuple(r) for r in picked.collect()), key=lambda t: [(v is not None, str(v)) for v in t]
        )

    return collected
