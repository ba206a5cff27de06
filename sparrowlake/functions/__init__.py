"""sparrowlake.functions"""
