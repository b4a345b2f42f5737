"""End-to-end plans (preprocess, train, price, dashboard), the query catalog and SQL oracles."""
