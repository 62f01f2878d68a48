from tessera.functions import stats, text

__all__ = ["stats", "text"]
