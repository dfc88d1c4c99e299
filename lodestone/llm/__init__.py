"""Training-data operators: one module each, registered by :mod:`lodestone.llm.registry`."""
