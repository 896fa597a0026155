"""Card-ledger jobs as functions from DataFrame to DataFrame."""
