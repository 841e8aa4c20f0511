from tillwise.sources.tables import Tables

__all__ = ["Tables"]
