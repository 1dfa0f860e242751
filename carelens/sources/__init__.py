"""Table schemas, loaders and adapters that turn the driver's star schema into clinical tables."""
