import pytest

from sitemarks.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(4, "sitemarks-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    session.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    yield session
    session.stop()


@pytest.fixture
def page_table(spark):
    """Pages from ``html`` texts or dicts of columns."""

    def make(*pages):
        rows = []
        for i, page in enumerate(pages):
            page = {"html": page} if not isinstance(page, dict) else page
            url = page.get("url", "https://example.com/page")
            rows.append(
                (i, page.get("original_url", url), url, page.get("final_url", url), page.get("status", 200),
                 page.get("headers", {}), page.get("set_cookies"), page.get("network"), page.get("html"))
            )
        return spark.createDataFrame(
            rows,
            "page_id bigint, original_url string, requested_url string, final_url string, http_status int, "
            "headers map<string,string>, set_cookies array<string>, network array<string>, html string",
        ).selectExpr("*", "timestamp'2024-05-01 10:00:00' AS fetched_at")

    return make
