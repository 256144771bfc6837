"""opineflow.functions"""
