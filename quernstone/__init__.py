"""quernstone: text-screening analytics and corpus preparation expressed as PySpark DataFrame programs."""
