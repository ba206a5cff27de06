"""sparrowlake.streaming"""
