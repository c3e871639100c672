"""Raw web pages."""


def read_pages(spark, sf_dir):
    """Pages to extract articles from: ``page_id, url, html``."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
