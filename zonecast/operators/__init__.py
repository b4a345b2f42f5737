"""DataFrame operators: ``DataFrame -> DataFrame`` functions, composable with ``DataFrame.transform``."""
