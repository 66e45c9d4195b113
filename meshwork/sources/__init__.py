from .products import (  # noqa: F401
    PANDAS_NULL_TOKENS, discover_products, product_name, publish_product,
    read_product, read_product_csv, write_product,
)
from .commit_log import CommitLog  # noqa: F401
