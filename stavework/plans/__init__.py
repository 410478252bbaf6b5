"""The named queries; importing a module of this package registers its own."""
