"""The registered queries; the registry loads all modules in an order that suits them."""

from . import registry  # noqa: F401
